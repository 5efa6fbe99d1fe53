"""Benchmark decontamination on template windows.

Words become canonical tokens: numbers, units behind a number, and runs of capitalised words inside a sentence (names, of one word or several) become the
placeholders of their type; any other word is itself, in lower case and without surrounding punctuation. Windows of
WINDOW tokens with at least LITERALS literal ones are hashed, and equal hashes joined, so that a question with other
numbers or names still meets its template. A capitalised word that begins a sentence or a text may be a name or not: an item has
windows for each reading (names leave half of the window literal), a document for none and for all of them as names.
(A capitalised word that begins a sentence and stands before a name belongs to it.)
Every window of an item, however few literals it has, also takes part word by word, so that a verbatim copy always meets. Along one alignment (document place minus item place) slots are
judged one by one: a value of the item stands for the document's value that it most often meets (its own, if that ties), and
different values may stand for the same. A window counts if it has the item's own values, or if half of
its slots or more have the value that the item's stands for. What such windows cover of the item decides.

The benchmark's windows are the stated query set: they are counted, and run over all documents in blocks of at most
BLOCK_WINDOWS distinct hashes (32 MB), each broadcast; a text is hashed where it lies and only its meeting windows travel.

Defined edge cases: null, empty and blank texts or items have no windows; items shorter than WINDOW tokens are one
shorter window, matched in full by the same rules; repeated items are reported under their own ids; repeated document rows add their windows to one
id's; null ids are ignored; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..plans.tables import materialise
from .textbatch import Numbering, flat, map_texts, mix, rolling

WINDOW, LITERALS, MIN_SHARE, MIN_TOKENS = 8, 5, 0.5, 20
BLOCK_WINDOWS = 4_000_000
#: Words whose windows a task hashes at a time: some 200 bytes each.
PART_WORDS = 100_000
_STRIP = ".,;:!?*#$%&|<>\"'()[]{}«»„“”‘’…-"
_NUMBER = re.compile(r"[+-]?[0-9][0-9.,:/]*[^\W\d_]{0,4}")
#: Words for units of measure, and small numbers in words, in English, German, French and Spanish (without those that are articles too).
UNITS = frozenset([
    "mm", "cm", "m", "km", "g", "kg", "mg", "ml", "cl", "l", "s", "h", "kmh", "kph", "mph", "kb", "mb", "gb", "tb", "kilometer", "kilometers",
    "kilometre", "kilometres", "meter", "meters", "metre", "metres", "mile", "miles", "inch", "inches", "foot", "feet", "ft", "yard", "yards",
    "gram", "grams", "kilogram", "kilograms", "pound", "pounds", "lb", "lbs", "ounce", "ounces", "oz", "ton", "tons", "tonne", "tonnes", "liter",
    "liters", "litre", "litres", "gallon", "gallons", "cup", "cups", "sec", "second", "seconds", "min", "minute", "minutes", "hour", "hours", "day",
    "days", "week", "weeks", "month", "months", "year", "years", "percent", "degrees", "degree", "celsius", "fahrenheit", "dollar", "dollars", "usd",
    "euro", "euros", "eur", "cent", "cents", "watt", "watts", "volt", "volts", "joule", "joules", "newton", "newtons",
    "gramm", "kilogramm", "pfund", "tonnen", "sekunde", "sekunden", "minuten", "stunde", "stunden", "tag", "tage", "tagen", "woche", "wochen",
    "monat", "monate", "monaten", "jahr", "jahre", "jahren", "prozent", "grad",
    "mètre", "mètres", "kilomètre", "kilomètres", "gramme", "grammes", "kilogramme", "kilogrammes", "livre", "livres", "seconde", "secondes",
    "heure", "heures", "jour", "jours", "semaine", "semaines", "mois", "an", "ans", "année", "années", "pourcent", "degré", "degrés", "centime",
    "centimes",
    "metro", "metros", "kilómetro", "kilómetros", "gramo", "gramos", "kilogramo", "kilogramos", "libra", "libras", "tonelada", "toneladas", "litro",
    "litros", "segundo", "segundos", "minuto", "minutos", "hora", "horas", "día", "días", "semana", "semanas", "mes", "meses", "año", "años",
    "grado", "grados", "dólar", "dólares", "céntimo", "céntimos",
])
NUMBER_WORDS = frozenset([
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen",
    "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand",
    "million",
    "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun", "zehn", "elf", "zwölf", "zwanzig", "dreißig", "vierzig", "fünfzig", "sechzig",
    "siebzig", "achtzig", "neunzig", "hundert", "tausend",
    "deux", "trois", "quatre", "cinq", "sept", "huit", "neuf", "dix", "onze", "douze", "treize", "quatorze", "quinze", "seize", "vingt", "trente",
    "quarante", "cinquante", "soixante", "cent", "mille",
    "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve", "diez", "once", "doce", "trece", "catorce", "quince", "veinte", "treinta",
    "cuarenta", "cincuenta", "sesenta", "setenta", "ochenta", "noventa", "cien", "mil",
])
_NUM, _UNIT, _NAME = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"<num>", b"<unit>", b"<name>"))


def _classes(words: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of each distinct word: its core, its literal hash, and bits: 1 number, 2 unit, 4 capitalised, 8 ends a sentence, 16 empty."""
    cores, hashes, bits = [], np.zeros(len(words), np.uint64), np.zeros(len(words), np.int64)
    for i, raw in enumerate(words):
        word = raw.decode("utf-8", "replace")
        core = word.strip(_STRIP)
        low = core.lower()
        cores.append(core)
        hashes[i] = xxhash.xxh3_64_intdigest(low.encode())
        bits[i] = (
            (1 if _NUMBER.fullmatch(core) or low in NUMBER_WORDS else 0) | (2 if low in UNITS else 0)
            | (4 if core[:1].isupper() and core[1:] == core[1:].lower() else 0) | (8 if word.rstrip("\"')»”*#$%&").endswith((".", "!", "?", ":")) else 0) | (0 if core else 16)
        )
    return cores, hashes, bits


@dataclass
class _Reading:
    """Tokens of a chunk of texts, one by one."""

    offsets: np.ndarray  # where each text begins
    literal: np.ndarray  # hash of each token
    kind: np.ndarray  # 0 literal, 1 number, 2 unit, 3 name
    either: np.ndarray  # whether a literal may be a name too
    begin: np.ndarray  # the words of each token, among all words of the chunk
    end: np.ndarray
    words: list[str]

    def value(self, q: int) -> str:
        return " ".join(self.words[k] for k in range(self.begin[q], self.end[q]))


class _Words(list):
    """The words of a chunk: numbers of the different ones."""

    def __init__(self, cores: list[str], at: np.ndarray):
        self.cores, self.at = cores, at

    def __getitem__(self, k: int) -> str:
        return self.cores[self.at[k]]


def _parts(texts: list[bytes], words: int) -> Iterator[tuple[int, tuple[_Reading, _Reading]]]:
    """The readings of runs of texts of about ``words`` words, and which text each run begins with. The different words are looked at once for all texts."""
    number = Numbering()
    at, offsets = flat((t.split() for t in texts), number, np.int32)
    cores, hashes, bits = _classes(list(number))
    del number
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + words, "right")) - 1)
        yield begin, _read(at[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin], cores, hashes, bits)
        begin = end


def _readings(texts: list[bytes]) -> tuple[_Reading, _Reading]:
    """Word by word, and with placeholders, where a name of several words is one token."""
    number = Numbering()
    at, offsets = flat((t.split() for t in texts), number, np.int32)
    return _read(at, offsets, *_classes(list(number)))


def _read(at: np.ndarray, offsets: np.ndarray, cores: list[str], hashes: np.ndarray, bits: np.ndarray) -> tuple[_Reading, _Reading]:
    b = bits[at]
    keep = b & 16 == 0
    ahead = np.concatenate(([0], np.cumsum(keep)))
    at, b, offsets = at[keep], b[keep], ahead[offsets]
    first = np.zeros(len(at) + 1, bool)
    first[offsets] = True
    ends, first = first[1:], first[:-1]
    before = np.concatenate(([8], b[:-1]))
    kind = np.where(b & 1, 1, np.where((b & 2 > 0) & (before & 1 > 0) & ~first, 2, np.where((b & 4 > 0) & (before & 8 == 0) & ~first, 3, 0)))
    either = (b & 4 > 0) & (kind == 0)
    literal = hashes[at] if len(at) else np.zeros(0, np.uint64)
    words, place = _Words(cores, at), np.arange(len(at))
    plain = _Reading(offsets, literal, np.zeros_like(kind), np.zeros_like(either), place, place + 1, words)
    leads = either & (np.append(kind[1:], 0)[: len(kind)] == 3) & ~ends
    kind = np.where(leads, 3, kind)
    goes_on = (kind == 3) & (np.append(0, kind[:-1])[: len(kind)] == 3) & ~first
    some = np.flatnonzero(~goes_on)
    return plain, _Reading(np.concatenate(([0], np.cumsum(~goes_on)))[offsets], literal[some], kind[some], (either & ~leads)[some], some, np.append(some[1:], len(at))[: len(some)], words)


def _template(literal: np.ndarray, kind: np.ndarray) -> np.ndarray:
    return np.choose(kind, [literal, _NUM, _UNIT, _NAME]).astype(np.uint64)


def _hashed(token: np.ndarray, width: int, window: int) -> np.ndarray:
    """Hashes of all windows; a whole item that is shorter than a window has hashes of its own."""
    return rolling(token, width) if width == window else mix(rolling(token, width) + np.uint64(width))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """item_id, n_tokens, at, first, last (the words that it covers), width, hash, spots, slots (place and value of each slot) of all readings of all windows of all items."""

    def cut(kept, texts):
        rows = []
        plain, named = _readings(texts)
        token = _template(named.literal, named.kind)
        for k, item in enumerate(kept[0].to_pylist()):
            a, b = plain.offsets[k : k + 2].tolist()
            width = min(window, b - a)
            if not width:
                continue
            rows += [(item, b - a, p, p, p + width, width, h, [], []) for p, h in enumerate(_hashed(plain.literal[a:b], width, window).tolist())]
            n, (a, b) = b - a, named.offsets[k : k + 2].tolist()
            first, width = plain.offsets[k], min(window, b - a)
            strict = _hashed(token[a:b], width, window).tolist()
            for p in range(a, b - width + 1):
                slots = [q for q in range(p, p + width) if named.kind[q]]
                names = [q for q in range(p, p + width) if named.either[q]]
                if width - len(slots) < literals:
                    continue
                found = {strict[p - a]: slots} if slots else {}
                for m in range(1, min(len(names), width - len(slots) - window // 2) + 1):
                    for some in combinations(names, m):
                        read = token[p : p + width].copy()
                        read[[q - p for q in some]] = _NAME
                        found[int(_hashed(read, width, window)[0])] = sorted([*slots, *some])
                rows += [(item, n, p - a, int(named.begin[p] - first), int(named.end[p + width - 1] - first), width, h, [q - a for q in x], [named.value(q) for q in x]) for h, x in found.items()]
        if not rows:
            return None
        c = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), *(pa.array(x, pa.int32()) for x in c[1:6]), pa.array(np.array(c[6], np.uint64).view(np.int64)), pa.array(c[7], pa.list_(pa.int32())), pa.array(c[8], pa.list_(pa.string()))], ["item_id", "n_tokens", "at", "first", "last", "width", "hash", "spots", "slots"])

    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return map_texts(items, cut, "item_id long, n_tokens int, at int, first int, last int, width int, hash long, spots array<int>, slots array<string>", ("item_id",))


def _meetings(docs: DataFrame, hashes: np.ndarray, widths: list[int], window: int) -> DataFrame:
    """doc_id, at, hash, slots of the document windows whose hash is in the sorted ``hashes``."""
    shared = docs.sparkSession.sparkContext.broadcast(hashes)

    def meet(kept, texts):
        known = shared.value
        ids = kept[0].to_numpy(zero_copy_only=False)
        rows = []
        for begin, (plain, named) in _parts(texts, PART_WORDS):
            for width in widths:
                # word by word; with placeholders where there are any; first words as names where there are any
                for read, kinds, has in ((plain, plain.kind, None), (named, named.kind, named.kind > 0), (named, np.where(named.either, 3, named.kind), named.either)):
                    values = _hashed(_template(read.literal, kinds), width, window)
                    if has is None:
                        some = np.arange(len(values))
                    else:
                        ahead = np.concatenate(([0], np.cumsum(has)))
                        some = np.flatnonzero(ahead[width:][: len(values)] > ahead[: len(values)])
                    place = np.minimum(np.searchsorted(known, values[some]), len(known) - 1)
                    some = some[known[place] == values[some]]
                    doc = np.searchsorted(read.offsets, some, "right") - 1
                    inside = some + width <= read.offsets[doc + 1]
                    some, doc = some[inside], doc[inside]
                    if has is None and len(some):
                        # such a window leaks its tokens wherever it stands: once for each document
                        order = np.lexsort((some, values[some], doc))
                        some, doc = some[order], doc[order]
                        new = np.append(True, (values[some[1:]] != values[some[:-1]]) | (doc[1:] != doc[:-1]))
                        some, doc = some[new], doc[new]
                    for p, d in zip(some.tolist(), doc.tolist(), strict=True):
                        rows.append((ids[begin + d], p - int(read.offsets[d]), int(values[p]), [read.value(q) for q in range(p, p + width) if kinds[q]]))
        if not rows:
            return None
        c = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(np.array(c[2], np.uint64).view(np.int64)), pa.array(c[3], pa.list_(pa.string()))], ["doc_id", "at", "hash", "slots"])

    return map_texts(docs, meet, "doc_id long, at int, hash long, slots array<string>")


def _judge(batches):
    """Of each alignment: the item's tokens that its consistent windows cover, and whether all of these have the item's own values."""
    for b in batches:
        covered, same = [], []
        for windows in b.column(3).to_pylist():
            met = Counter((i, d) for _, i, d in {(p["q"], p["i"], p["d"]) for w in windows for p in w["pairs"]})
            usual = {}
            for (i, d), _ in sorted(met.items(), key=lambda x: (x[1], x[0][0] == x[0][1], x[0])):
                usual[i] = d
            tokens, own = set(), True
            for w in windows:
                equal = all(p["i"] == p["d"] for p in w["pairs"])
                if equal or 2 * sum(usual[p["i"]] == p["d"] for p in w["pairs"]) >= len(w["pairs"]):
                    tokens.update(range(w["first"], w["last"]))
                    own &= equal
            covered.append(sorted(tokens))
            same.append(own)
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), pa.array(covered, pa.list_(pa.int32())), pa.array(same)], ["doc_id", "item_id", "n_tokens", "tokens", "same"])


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, min_share: float = MIN_SHARE, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """doc_id, item_id, covered, n_tokens, kind of every contaminated (document, item).

    An item is leaked if consistent alignments cover at least ``min_share`` of its tokens, or ``min_tokens`` of them.
    kind is 'verbatim' if all slots of these have the item's own values, else 'reparameterised'.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = materialise(benchmark_windows(benchmark, window, literals))
    blocks = max(1, -(-items.count() // BLOCK_WINDOWS))
    block = F.pmod(F.xxhash64("hash"), F.lit(blocks))
    found = None
    for b in range(blocks):
        mine = items.where(block == b).select("hash", "width").distinct().toPandas()
        if len(mine):
            part = _meetings(docs, np.sort(mine["hash"].to_numpy(np.int64).view(np.uint64)), sorted(set(mine["width"].tolist())), window)
            found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, covered int, n_tokens int, kind string")
    found = materialise(found)  # meeting windows only; read twice below
    # windows without slots need no alignment: each different one of a document meets the item's tokens that its equals cover
    bare = F.size("slots") == 0
    spans = items.where(bare).groupBy("item_id", "n_tokens", "hash").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("first", F.col("last") - 1)))).alias("tokens"))
    literal = found.where(bare).select("doc_id", "hash").distinct().join(spans, "hash").select("doc_id", "item_id", "n_tokens", "tokens", F.lit(True).alias("same"))
    met = found.where(~bare).select("doc_id", F.col("at").alias("place"), "hash", F.col("slots").alias("values")).join(items.where(~bare), "hash")
    pairs = F.arrays_zip(F.col("spots").alias("q"), F.transform("slots", F.lower).alias("i"), F.transform("values", F.lower).alias("d"))
    aligned = (
        met.select("doc_id", "item_id", "n_tokens", (F.col("place") - F.col("at")).alias("shift"), F.struct("first", "last", pairs.alias("pairs")).alias("window"))
        .groupBy("doc_id", "item_id", "n_tokens", "shift").agg(F.collect_set("window").alias("windows")).drop("shift")
    )
    judged = aligned.mapInArrow(_judge, "doc_id long, item_id long, n_tokens int, tokens array<int>, same boolean").union(literal)
    return (
        judged.groupBy("doc_id", "item_id", "n_tokens")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_set("tokens")))).alias("covered"), F.bool_and("same").alias("same"))
        .where((F.col("covered") >= min_share * F.col("n_tokens")) | (F.col("covered") >= min_tokens))
        .select("doc_id", "item_id", "covered", "n_tokens", F.when(F.col("same"), "verbatim").otherwise("reparameterised").alias("kind"))
    )
