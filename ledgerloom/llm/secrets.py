"""Secret scans with DataFrame functions only.

Base rules are regular expressions. The method adds tokens that look random: runs of at least MIN_TOKEN characters of
``[A-Za-z0-9+/_-]`` with a letter and a digit that meet no base span. Each goes through a battery against the hypothesis that its
characters are uniform draws from its inferred alphabet (hex 16, base32 32, alphanumeric 62, base64 64): chi-squared
uniformity, runs about the middle of the alphabet, and circular lag-one serial correlation. Three times the smallest of the
three p-values is the token's p. Structured tokens (names, paths, sentences run together) have small ones. What the base rules find is
tested in the same way; it stays whatever its p is, which ``p_values`` tells.

False discoveries, structured tokens that pass, are controlled for each encoding and length class apart, because the
tests' power grows with length: random tokens pass a cut t at the known rate (1 - t/3)^3, so the tokens with
p >= 0.5 tell how many random ones there are, what passes a cut beyond them is false, and the class takes the lowest cut that
keeps the false share at FALSE_SHARE or less. A class with fewer than EVIDENCE tokens of p >= 0.5 is judged with all lengths of its encoding
together, and an encoding that has fewer adds nothing. The table of cuts is made from all documents and has a fixed size.

Running positions are added up block by block (BLOCK matches), and a token is looked up among the sorted base spans, so a text
costs about as much as it has characters and matches.

Positions count code points, ends are exclusive. Defined edge cases: null and empty texts have no spans (the digest
is that of the empty string); repeated rows are scanned each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: The base rules.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Only runs that are long enough can pass, and a run's match always begins where the run does.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_VALUE = 12
KINDS = ("assign", "access", "hex", "random")

MIN_TOKEN, MIN_TESTED, BINS, FALSE_SHARE, EVIDENCE, BLOCK = 20, 8, 40, 0.05, 10, 256
TOKEN = r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_TOKEN
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alnum": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def _literal(text: str) -> str:
    return "r'" + text.replace("'", r"\x27") + "'"


def let(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with ``value``, worked out once, under ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def before_each(items: str, value: str, combine: str) -> str:
    """SQL of an array with, for each item, ``combine`` of the values of all items before it (0 for none).

    value: of item ``x``; combine: of ``t`` and ``v``. Each block's result starts the blocks behind it, so no array is built item by item.
    """
    step = f"transform(array({value}), v -> {combine})[0]"
    block = f"slice(items, cast(b * {BLOCK} + 1 as int), {BLOCK})"
    results = f"transform(blocks, b -> aggregate({block}, 0, (t, x) -> {step}))"
    starts = f"aggregate({results}, named_struct('t', 0, 'out', cast(array() as array<int>)), (a, v) -> named_struct('t', {let('a.t', 't', combine)}, 'out', concat(a.out, array(a.t))), a -> a.out)"
    within = f"aggregate({block}, named_struct('t', s, 'out', cast(array() as array<int>)), (a, x) -> named_struct('t', {let('a.t', 't', step)}, 'out', concat(a.out, array(a.t))), a -> a.out)"
    whole = let("sequence(0, cast((size(items) - 1) div {BLOCK} as int))".replace("{BLOCK}", str(BLOCK)), "blocks", f"flatten(zip_with(blocks, {starts}, (b, s) -> {within}))")
    return let(items, "items", f"if(size(items) = 0, cast(array() as array<int>), {whole})")


def _spans(found: str, text: str, pattern: str) -> str:
    """(s, e, m) of each match: the pieces between them tell where they lie."""
    matches = f"transform(sequence(1, size({found})), i -> named_struct('m', {found}[i - 1], 'n', length(pieces[i - 1]), 'l', length({found}[i - 1])))"
    placed = f"zip_with(matches, {before_each('matches', 'x.n + x.l', 't + v')}, (x, t) -> named_struct('s', t + x.n, 'e', t + x.n + x.l, 'm', x.m))"
    return f"if(size({found}) = 0, cast(array() as array<struct<s:int,e:int,m:string>>), {let(f'split({text}, {_literal(pattern)}, -1)', 'pieces', let(matches, 'matches', placed))})"


def _p(z: str) -> str:
    """Upper tail of the normal distribution, to about 1e-4."""
    return f"(1 / (1 + exp(least(greatest(1.5976 * ({z}) + 0.070566 * pow(({z}), 3), -500D), 500D))))"


def _meets(span: str, others: str) -> str:
    """SQL: whether a span meets one of the sorted, disjoint ``others``: the last that begins before its end, by halving."""
    last = f"aggregate(sequence(1, 31), named_struct('lo', 0, 'hi', size({others})), (a, i) -> if(a.lo >= a.hi, a, if({others}[(a.lo + a.hi) div 2].s < {span}.e, named_struct('lo', cast((a.lo + a.hi) div 2 + 1 as int), 'hi', a.hi), named_struct('lo', a.lo, 'hi', cast((a.lo + a.hi) div 2 as int)))), a -> a.lo)"
    return let(last, "at", f"if(at = 0, false, {others}[at - 1].e > {span}.s)")


def with_tested(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, and ``__assign``, ``__access``, ``__hex`` (s, e, m) and ``__tested`` (k, s, e, encoding, size, p): the base spans and the
    tokens that meet none of them, by the battery; k is the kind's number."""
    text = "coalesce(text, '')"
    out = docs.withColumn("__text", F.expr(text))
    for kind, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("token", TOKEN)):
        out = out.withColumn("__found", F.expr(f"regexp_extract_all(__text, {_literal(pattern)}, 0)")).withColumn(f"__{kind}", F.expr(_spans("__found", "__text", pattern))).drop("__found")
    value = f"regexp_extract(x.m, {_literal(ASSIGN)}, 2)"
    out = out.withColumn("__assign", F.expr(f"filter(__assign, x -> length({value}) >= {MIN_VALUE})"))
    free = " and ".join(f"not {_meets('x', f'__{k}')}" for k in KINDS[:3])
    parts = [f"transform(__{kind}, x -> named_struct('k', {k}, 's', x.s, 'e', x.e, 'm', regexp_replace({m}, '[.=]+', '')))" for k, (kind, m) in enumerate((("assign", value), ("access", "x.m"), ("hex", "x.m")))]
    parts.append(f"transform(filter(__token, x -> x.m rlike '[0-9]' and x.m rlike '[A-Za-z]' and {free}), x -> named_struct('k', 3, 's', x.s, 'e', x.e, 'm', regexp_replace(x.m, '=+$', '')))")
    out = out.withColumn("__tokens", F.expr(f"filter(concat({', '.join(parts)}), x -> length(x.m) >= {MIN_TESTED})"))
    coded = "case " + " ".join(f"when x.encoding = '{k}' then transform(x.chars, c -> instr('{v}', c) - 1)" for k, v in ALPHABETS.items()) + " end"
    size = "case " + " ".join(f"when x.encoding = '{k}' then {len(v)}D" for k, v in ALPHABETS.items()) + " end"
    at = "'k', x.k, 's', x.s, 'e', x.e, 'encoding', x.encoding"
    steps = [
        """named_struct('k', x.k, 's', x.s, 'e', x.e, 'm', x.m, 'encoding', case
            when x.m rlike '^([0-9a-f]+|[0-9A-F]+)$' then 'hex' when x.m rlike '^[A-Z2-7]+$' then 'base32'
            when x.m rlike '^[A-Za-z0-9]+$' then 'alnum' else 'base64' end)""",
        f"""named_struct({at}, 'chars', filter(split(
            case x.encoding when 'hex' then lower(x.m) when 'base64' then translate(x.m, '-_', '+/') else x.m end, ''), c -> c <> ''))""",
        f"""named_struct({at}, 'a', {size}, 'n', cast(size(x.chars) as double), 'v', {coded},
            'squares', aggregate(array_distinct(x.chars), 0D, (t, d) -> t + pow(size(filter(x.chars, c -> c = d)), 2)))""",
        f"""named_struct({at}, 'a', x.a, 'n', x.n, 'chi', x.a / x.n * x.squares - x.n,
            'high', cast(size(filter(x.v, c -> c >= x.a / 2)) as double),
            'runs', 1D + size(filter(sequence(1, size(x.v) - 1), i -> (x.v[i] >= x.a / 2) <> (x.v[i - 1] >= x.a / 2))),
            'sum', aggregate(x.v, 0D, (t, c) -> t + c), 'sum2', aggregate(x.v, 0D, (t, c) -> t + c * c),
            'next', aggregate(sequence(0, size(x.v) - 1), 0D, (t, i) -> t + x.v[i] * x.v[(i + 1) % size(x.v)]))""",
        f"""named_struct({at}, 'n', x.n,
            'chi', (pow(x.chi / (x.a - 1), 1D / 3) - (1 - 2 / (9 * (x.a - 1)))) / sqrt(2 / (9 * (x.a - 1))),
            'runs', try_divide(x.runs - 1 - 2 * x.high * (x.n - x.high) / x.n,
                sqrt(greatest(2 * x.high * (x.n - x.high) * (2 * x.high * (x.n - x.high) - x.n) / (x.n * x.n * (x.n - 1)), 0D))),
            'serial', try_divide(try_divide(x.n * x.next - x.sum * x.sum, x.n * x.sum2 - x.sum * x.sum) + 1 / (x.n - 1),
                sqrt(x.n * (x.n - 3) / ((x.n + 1) * (x.n - 1) * (x.n - 1)))))""",
        # one symbol only, or one half of the alphabet only: no test statistic, and no randomness
        f"""named_struct({at}, 'size', cast(floor(log2(x.n) * 2) as int),
            'p', coalesce(least(1D, 3 * least({_p('x.chi')}, 2 * {_p('abs(x.runs)')}, 2 * {_p('abs(x.serial)')})), 0D))""",
    ]
    for step in steps:
        out = out.withColumn("__tokens", F.expr(f"transform(__tokens, x -> {step})"))
    return out.withColumnRenamed("__tokens", "__tested").drop("__text", "__token")


def discovery_cuts(tested: DataFrame, share: float = FALSE_SHARE) -> dict[tuple[str, int], float]:
    """Lowest p that a token of an encoding and size may have: a table of at most some 150 entries, from all documents."""
    histogram = (
        tested.select(F.explode(F.filter("__tested", lambda t: t["k"] == 3)).alias("t")).select("t.encoding", "t.size", F.least(F.floor(F.col("t.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
        .groupBy("encoding", "size", "bin").agg(F.count(F.lit(1)).alias("n")).collect()
    )
    counts: dict[tuple[str, int], list[int]] = {}
    whole: dict[str, list[int]] = {}
    for r in histogram:
        counts.setdefault((r["encoding"], r["size"]), [0] * BINS)[r["bin"]] = r["n"]
        whole.setdefault(r["encoding"], [0] * BINS)[r["bin"]] += r["n"]
    passing = lambda t: (1 - t / 3) ** 3
    cuts = {}
    for (encoding, size), n in counts.items():
        if sum(n[BINS // 2 :]) < EVIDENCE:
            n = whole[encoding]
        if sum(n[BINS // 2 :]) < EVIDENCE:
            continue
        random = sum(n[BINS // 2 :]) / passing(0.5)
        for b in range(1, BINS // 2):
            passed = sum(n[b:])
            if passed and passed - random * passing(b / BINS) <= share * passed:
                cuts[encoding, size] = b / BINS
                break
    return cuts


def with_spans(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, and ``__spans``: (s, k, e) of every span by start, then kind, and ``__p``: (s, k, p) of those that were tested."""
    tested = with_tested(docs)
    cuts = discovery_cuts(tested)
    passes = "false"
    if cuts:
        passes = " or ".join(f"(x.encoding = '{e}' and x.size = {n} and x.p >= {cut}D)" for (e, n), cut in sorted(cuts.items()))
    out = tested.withColumn("__tested", F.expr(f"filter(__tested, x -> x.k < 3 or {passes})"))
    parts = [f"transform(__{kind}, x -> named_struct('s', x.s, 'k', {k}, 'e', x.e))" for k, kind in enumerate(KINDS[:3])]
    parts.append("transform(filter(__tested, x -> x.k = 3), x -> named_struct('s', x.s, 'k', 3, 'e', x.e))")
    out = out.withColumn("__spans", F.expr(f"array_sort(concat({', '.join(parts)}))")).withColumn("__p", F.expr("array_sort(transform(__tested, x -> named_struct('s', x.s, 'k', x.k, 'p', x.p)))"))
    return out.drop("__tested", *(f"__{k}" for k in KINDS[:3]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random, base_spans, p_values of every row.

    ``spans`` lists kind:start:end by start, then kind, joined by commas; ``base_sha256`` digests the base ones of it; ``p_values``
    lists kind:start:p of the spans whose value has MIN_TESTED characters or more.
    """
    out = with_spans(docs.select("doc_id", "text"))
    names = ", ".join(f"'{k}'" for k in KINDS)
    show = lambda c: F.expr(f"array_join(transform({c}, x -> concat(array({names})[x.k], ':', x.s, ':', x.e)), ',')")
    counts = [F.expr(f"cast(size(filter(__spans, x -> x.k = {k})) as long)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    base = show("filter(__spans, x -> x.k < 3)")
    tested = F.expr(f"array_join(transform(__p, x -> concat(array({names})[x.k], ':', x.s, ':', format_number(x.p, 4))), ',')")
    return out.select("doc_id", *counts[:3], F.sha2(base, 256).alias("base_sha256"), show("__spans").alias("spans"), counts[3], base.alias("base_spans"), tested.alias("p_values"))


def redacted(docs: DataFrame, mark: str = "<SECRET>") -> DataFrame:
    """``docs`` with every secret's span in ``text`` replaced by ``mark``; all rows and columns stay, a null text stays null."""
    # what a span shares with those before it is dropped once
    cut = let("__spans", "spans", let(before_each("spans", "x.e", "greatest(t, v)"), "ends", (
        f"concat(array_join(zip_with(spans, ends, (x, t) -> if(x.s >= t, concat(substring(text, t + 1, x.s - t), '{mark}'), '')), ''), "
        "substring(text, array_max(transform(spans, x -> x.e)) + 1))"
    )))
    return with_spans(docs).withColumn("text", F.expr(f"if(size(__spans) = 0, text, {cut})")).select(*docs.columns)
