"""Exact set-similarity join of documents on word shingles, by vertical partitioning.

The global order of shingles is the order of their 64-bit hashes. It is cut into fragments; candidates come from fragments
that agree, and a pair's overlap is counted fragment by fragment and summed.

1. A document's set is reduced to a class: documents with equal sets share one, so copies are one set from
   here on (and are written once per task).
2. Candidates. Sets are compared in size spaces whose bounds grow by a quarter; a set takes part in its own
   space and the next. In a space with largest size u the order is cut into k = 0.27 u + 1 fragments. Two sets
   with Jaccard >= 0.8 differ in at most (|x| + |y|) / 9 shingles, and a shingle spoils one fragment, so at
   least L = (fragments that x fills) - (|x| + max |y|) / 9 filled fragments agree as a whole. A fragment's
   content is one key, its signature. Sets with L <= 0 (short ones) also have prefix signatures. A chunk of documents sends each signature once and
   learns which ones others have too (see exchange); only those become rows (signature, class).
   Signatures of one class alone are dropped; a class with fewer than L others links with nothing. This leaves the
   members of near-duplicate groups, and few texts that only share a passage.
3. Each of them is compared with the smallest and largest classes of its signatures that it shares most with, then with
   those that have most links, and what that links is contracted. Links inside a component can't change the result: a large group costs a few
   comparisons for each member. Classes that share L signatures or more with other components remain.
4. Pairs in different components. Over the remaining sets shingles are ordered from rare to frequent; sets that are
   similar share one of their first ones (prefix and position filters, by size class), and differ in no more bits of
   their odd sketches than they may in shingles. Where the sets that have a shingle
   first are mostly of one component, only the others are paired with them.
5. Counting. Every set is cut into FRAGMENTS fragments of the order (twice as many for each doubling of its size over PART shingles), two sets'
   common shingles are counted in each fragment apart, and the counts are summed for each pair.

Class and shingle hashes have 64 bits; two of n different sets fall together with a chance of n^2 / 2^65.

Rows are told apart by their id and a hash of their text. Defined edge cases: null, empty and blank texts have no shingles and link with nothing; fewer than five words are
one shingle; a null id takes part, but never names a component while another member has an id; repeated rows are
copies; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.components import connected_components
from ..plans.tables import BROADCAST_ROWS, discard, keyed_join, materialise
from .exchange import corpus_bytes, distinct, exchange, key_mask, planes, unplanes
from .textbatch import WordHash, flat, map_texts, mix, rolling

WIDTH, PART, FRAGMENTS = 5, 2048, 4
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _bounds() -> np.ndarray:
    low = [1]
    while low[-1] < 1 << 40:
        low.append(low[-1] * 5 // 4 + 1)
    return np.array(low, np.int64)


LOW = _bounds()


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    values, offsets = flat((t.lower().split() for t in texts), WordHash(), np.uint64)
    rolled = rolling(values, width)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(mix(rolling(values[a:b], int(b - a)) + np.uint64(int(_C) * int(b - a) % 2**64)))
        else:
            out.append(rolled[:0])
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def set_class(shingles: np.ndarray) -> int | None:
    return int(np.array(xxhash.xxh3_64_intdigest(shingles.tobytes()), np.uint64).view(np.int64)) if len(shingles) else None


def _spaces(shingles: np.ndarray, percent: int):
    """(space, fragment numbers, where each filled fragment starts, signatures sure to be shared) of a set's spaces."""
    n = len(shingles)
    own = int(np.searchsorted(LOW, n, "right")) - 1
    largest, high = n * 100 // percent, shingles >> np.uint64(32)
    for space in (own, own + 1):
        if space > own and largest < LOW[space]:
            break
        top = int(LOW[space + 1]) - 1
        fragment = high * np.uint64(top * 27 // 100 + 1) >> np.uint64(32)
        starts = np.concatenate(([0], np.flatnonzero(fragment[1:] != fragment[:-1]) + 1))
        yield space, fragment, starts, len(starts) - (n + min(largest, top)) * (100 - percent) // (100 + percent)


def surely_shared(shingles: np.ndarray, percent: int = 80) -> int:
    """How many signatures any partner is sure to share."""
    return min((max(1, sure) for *_, sure in _spaces(shingles, percent)), default=0) if len(shingles) else 0


def signatures(shingles: np.ndarray, percent: int = 80) -> np.ndarray:
    """Signatures of one nonempty set."""
    n, mixed, out = len(shingles), mix(shingles + _A), []
    for space, fragment, starts, sure in _spaces(shingles, percent):
        salt = np.uint64(space * int(_B) % 2**64)
        out.append(mix(np.add.reduceat(mixed, starts) + fragment[starts] * _C + salt))
        if sure < 1:
            out.append(mix((shingles[: n - -(-n * percent // 100) + 1] ^ _B) + salt))
    return np.concatenate(out)


def _described(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, row, class, n and sure of every row, and (class, n, sure, signature) for each signature that may be shared by two classes."""
    size = corpus_bytes(docs)
    mask = key_mask(size, 26)
    names = ["doc_id", "row", "class", "n", "sure", "signature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    seen: set[int] = set()  # a task has a copy of its own

    def send(kept, texts):
        sets = shingle_sets(texts)
        classes = [set_class(s) for s in sets]
        sure = [surely_shared(s, percent) for s in sets]
        lists, own = [], []
        for k, (s, c) in enumerate(zip(sets, classes, strict=True)):
            if c is not None and c not in seen:
                seen.add(c)
                lists.append(signatures(s, percent))
                own.append(k)
        keys = np.concatenate(lists) & mask if lists else np.zeros(0, np.uint64)
        order, begins, _ = distinct(keys)
        owner = np.repeat(np.array(own, np.int64), [len(x) for x in lists])[order]
        times = np.diff(np.append(begins, len(keys)))
        none = [c is None for c in classes]
        ids = kept[0].fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"), kept[0].is_null().to_numpy(zero_copy_only=False), kept[1].to_numpy(zero_copy_only=False).astype("<i8")
        described = np.array([0 if c is None else c for c in classes], "<i8"), np.array(none, bool), np.array([len(s) for s in sets], "<i8"), np.array(sure, "<i4")
        return keys[order[begins]], [np.minimum(times, 2)], [x.tobytes() for x in (*ids, *described)] + [planes(times), planes(owner), len(begins).to_bytes(8, "little"), len(owner).to_bytes(8, "little")]

    def answer(keys, times):
        order, begins, which = distinct(keys)
        shared = np.add.reduceat(times[order], begins) > 1
        return [np.where(shared[which], keys, np.uint64(0))], None

    def receive(info, answers):
        ids, no_id, row, classes, none, n, sure = (np.frombuffer(x, t) for x, t in zip(info, ("<i8", bool, "<i8", "<i8", bool, "<i8", "<i4"), strict=False))
        every = pa.table([pa.array(ids, mask=no_id), pa.array(row), pa.array(classes, mask=none), pa.array(n), pa.array(sure), pa.nulls(len(ids), pa.int64())], names)
        if not answers:
            return every
        times, owner = unplanes(info[7], int.from_bytes(info[9], "little")).astype(np.int64), unplanes(info[8], int.from_bytes(info[10], "little")).astype(np.int64)
        signature = np.repeat(answers[0], times)
        some = signature != 0
        signature, owner = signature[some].view(np.int64), owner[some]
        shared = pa.table([pa.nulls(len(owner), pa.int64()), pa.nulls(len(owner), pa.int64()), pa.array(classes[owner]), pa.array(n[owner]), pa.array(sure[owner]), pa.array(signature)], names)
        return pa.concat_tables([every, shared]).cast(pa.schema(list(zip(names, kinds, strict=True))))

    return materialise(exchange(docs, send, answer, receive, "doc_id long, row long, class long, n long, sure int, signature long", ("doc_id", "row"), size=size))


def _memberships(rows: DataFrame) -> DataFrame:
    """(bucket, class, n, sure, low, high, times): buckets of two classes or more; times is in how many signatures."""
    rows = rows.distinct()
    whole = rows.groupBy("signature").agg(F.count(F.lit(1)).alias("size"), F.min("class").alias("low"), F.max("class").alias("high"), F.bit_xor("class").alias("x")).where("low < high")
    return (
        rows.join(whole, "signature").groupBy("low", "high", "size", "x", "class", "n", "sure").agg(F.count(F.lit(1)).alias("times"))
        .select(F.xxhash64("low", "high", "size", "x").alias("bucket"), "class", "n", "sure", "times")
    )


def _level(n: int, part: int) -> int:
    """log2 of the number of fragments: FRAGMENTS up to ``part`` shingles, twice as many for each doubling."""
    return FRAGMENTS.bit_length() - 1 + (0 if n <= part else (n - 1).bit_length() - (part - 1).bit_length())


def _level_column(n: Column) -> Column:
    return FRAGMENTS.bit_length() - 1 + F.ceil(F.greatest(F.log2(n / F.lit(float(PART))), F.lit(0.0))).cast("int")


def odd_sketch(shingles: np.ndarray) -> list[int]:
    """256 parities: two sets' sketches differ in no more bits than the sets differ in shingles."""
    odd = np.bincount((shingles & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def cut_sets(docs: DataFrame, chosen: DataFrame, percent: int = 80) -> DataFrame:
    """(class, n, level, part, shingles, sketch) of the chosen (class, rep), in the fragments that their partners may need."""
    part = PART
    chosen_rows = materialise(chosen.select(F.col("rep").alias("row")).distinct())

    def cut(_, texts):
        rows, lists = [], []
        for s in shingle_sets(texts):
            c = set_class(s)
            if c is None:
                continue
            sketch = odd_sketch(s)
            for level in sorted({_level(len(s), part), _level(len(s) * 100 // percent, part)}):
                cuts = [0, *(np.searchsorted(s, np.arange(1, 1 << level, dtype=np.uint64) << np.uint64(64 - level)) if level else ()), len(s)]
                for k in range(1 << level):
                    if cuts[k + 1] > cuts[k]:
                        rows.append((c, len(s), level, k, sketch))
                        lists.append(_signed(s[cuts[k] : cuts[k + 1]]))
        if not lists:
            return None
        ends = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
        c = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))], ["class", "n", "level", "part", "sketch", "shingles"])

    rows = map_texts(keyed_join(docs, chosen_rows, "row"), cut, "class long, n long, level int, part int, sketch array<long>, shingles array<long>", ())
    cut_rows = materialise(rows)
    # only rows that are the same in id and text come twice, and only these need the sets to be shuffled
    twice = cut_rows.groupBy("class", "level", "part").agg(F.count(F.lit(1)).alias("times")).where("times > 1").limit(1).count()
    return materialise(cut_rows.dropDuplicates(["class", "level", "part"])) if twice else cut_rows


def overlaps(sets: DataFrame, pairs: DataFrame, percent: int = 80) -> DataFrame:
    """The pairs (a, b, na, nb) of classes that reach the similarity; ``pairs`` is materialised."""
    wanted = pairs.withColumn("level", _level_column(F.greatest("na", "nb")))
    if pairs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    left = sets.select(F.col("class").alias("a"), "level", "part", F.col("shingles").alias("sa")).join(wanted, ["a", "level"])
    right = sets.select(F.col("class").alias("b"), "level", "part", F.col("shingles").alias("sb"))
    return (
        left.join(right, ["b", "level", "part"]).groupBy("a", "b", "na", "nb").agg(F.sum(F.size(F.array_intersect("sa", "sb"))).alias("common"))
        .where(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent).select("a", "b")
    )


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b, na, nb) of rows (class, n, other, m) whose sizes allow the similarity."""
    turned = F.col("class") < F.col("other")
    pick = lambda x, y: F.when(turned, F.col(x)).otherwise(F.col(y))
    able = rows.where(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent)
    return materialise(able.select(pick("class", "other").alias("a"), pick("other", "class").alias("b"), pick("n", "m").alias("na"), pick("m", "n").alias("nb")).distinct())


def _by_bucket(rows: DataFrame, buckets: DataFrame, how: str = "inner") -> DataFrame:
    """Join rows with one row for each bucket; a bucket may have a large share of the rows, so buckets are broadcast if they are counted few enough (4 MB)."""
    buckets = materialise(buckets)
    if buckets.limit(BROADCAST_ROWS // 5 + 1).count() <= BROADCAST_ROWS // 5:
        buckets = F.broadcast(buckets)
    return rows.join(buckets, "bucket", how)


def _hubs(spokes: DataFrame, most: int = 8) -> DataFrame:
    """(class, n, other, m): the ``most`` hubs that a class shares most signatures with; the second round looks at all the rest."""
    shared = spokes.where("class <> other").groupBy("class", "n", "sure", "other", "m").agg(F.sum("times").alias("shared")).where("2 * shared >= sure")
    return shared.withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("shared"), "other"))).where(F.col("r") <= most).select("class", "n", "other", "m")


def _rare_first(sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(class, n, other, m) of sets in different components that share a shingle among their first ones, rare shingles first."""
    own = sets.where(F.col("level") == _level_column(F.col("n"))).select("class", "n", F.explode("shingles").alias("shingle"))
    counts = own.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("class").orderBy("df", "shingle")
    # a smaller or equal partner of size m needs an overlap of (n + m) * percent / (100 + percent)
    need = lambda n, m: F.ceil((n + m) * percent / F.lit(100.0 + percent) - 1e-9)
    n, place = F.col("n"), F.col("place")
    smallest = F.ceil(n * percent / 100.0 - 1e-9)
    ranked = own.join(counts.where("df > 1"), "shingle", "right").where("class is not null").select("class", "n", "shingle", "df")
    # shingles of one set alone stand first, and no partner has them: only their number matters
    alone = sets.where(F.col("level") == _level_column(F.col("n"))).groupBy("class").agg(F.sum(F.size("shingles")).alias("whole"), F.first("sketch").alias("sketch"))
    shared = ranked.groupBy("class").agg(F.count(F.lit(1)).alias("shared"))
    ranked = ranked.join(alone.join(shared, "class").select("class", "sketch", (F.col("whole") - F.col("shared")).alias("first")), "class")
    ranked = ranked.withColumn("place", F.row_number().over(order) - 1 + F.col("first")).where(place < n - need(n, smallest) + 1)
    ranked = materialise(ranked.join(found, F.col("class") == F.col("node"), "left").select("class", "n", "shingle", "place", F.coalesce("component", "class").alias("component"), *(F.col("sketch")[k].alias(f"s{k}") for k in range(4))))
    step = F.log(F.lit(1.02))
    size_class = lambda m: F.floor(F.log(m.cast("double")) / step).cast("int")
    index = ranked.where(place < n - need(n, n) + 1).select("shingle", size_class(n).alias("size"), F.col("class").alias("other"), F.col("n").alias("m"), F.col("place").alias("other_place"), F.col("component").alias("other_component"), *(F.col(f"s{k}").alias(f"t{k}") for k in range(4)))
    # the partner sizes for which a place is early enough: place <= n - need
    least = F.ceil(F.exp(F.col("size") * step) - 1e-9)
    probe = ranked.select("*", F.explode(F.sequence(size_class(smallest), size_class(n))).alias("size")).where(place < n - need(n, F.greatest(least, smallest)) + 1)
    kinds = index.groupBy("shingle", "size").agg(F.mode("other_component", deterministic=True).alias("usual"), F.min("other_component").alias("one"), F.max("other_component").alias("last"))
    probe = probe.join(kinds, ["shingle", "size"]).where("one < last or one <> component")
    index = index.join(kinds.select("shingle", "size", "usual"), ["shingle", "size"])
    differ = sum((F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"t{k}"))) for k in range(4)), F.lit(0))
    close = differ * (100 + percent) <= (n + F.col("m")) * (100 - percent)
    able = close & (F.col("m") <= n) & (F.col("component") != F.col("other_component")) & (F.least(n - place, F.col("m") - F.col("other_place")) >= need(n, F.col("m")))
    unusual = probe.drop("usual").join(index.where("other_component <> usual").drop("usual"), ["shingle", "size"]).where(able)
    usual = probe.where("component <> usual").drop("usual").join(index.where("other_component = usual").drop("usual"), ["shingle", "size"]).where(able)
    return unusual.select("class", "n", "other", "m").union(usual.select("class", "n", "other", "m"))


def linked_rows(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, row, n and component of every row of ``docs`` (columns doc_id, row and text are read).

    ``row`` is row_key() of the row; component is the same number for all rows that are linked, null for rows without shingles.
    """
    described = _described(docs, percent)
    rows = materialise(described.where("signature is null").select("doc_id", "row", "class", "n"))
    members = materialise(_memberships(described.where("signature is not null").select("signature", "class", "n", "sure")))
    discard(described)
    able = members.groupBy("class").agg(F.sum("times").alias("total"), F.first("sure").alias("sure")).where("total >= sure").select("class")
    able = materialise(able)
    reps = rows.groupBy("class").agg(F.min("row").alias("rep")).join(able, "class", "left_semi")
    sets = cut_sets(docs, reps, percent)

    near = materialise(members.join(able, "class", "left_semi"))
    discard(members)
    size = F.struct("class", "n")
    ends = near.groupBy("bucket").agg(F.min(size).alias("low"), F.max(size).alias("high")).where("low.class < high.class")
    spokes = _by_bucket(near, ends).withColumn("x", F.explode(F.array("low", "high"))).select("class", "n", "sure", "times", F.col("x.class").alias("other"), F.col("x.n").alias("m"))
    pairs = _pairs(_hubs(spokes), percent)
    links = materialise(overlaps(sets, pairs, percent))
    # once more, with the member of each bucket that has most links so far
    found = connected_components(links, "a", "b").select(F.col("node").alias("class"), "component")
    degree = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("degree"))
    placed = materialise(near.join(found, "class", "left").join(degree, "class", "left").withColumn("component", F.coalesce("component", "class")))
    best = placed.where("degree > 0").groupBy("bucket").agg(F.max(F.struct("degree", "class", "n", "component")).alias("x")).select("bucket", F.col("x.class").alias("other"), F.col("x.n").alias("m"), F.col("x.component").alias("theirs"))
    more = materialise(_pairs(_hubs(_by_bucket(placed, best).where("component <> theirs")), percent).join(pairs, ["a", "b"], "left_anti"))
    links, pairs = materialise(links.union(overlaps(sets, more, percent))), pairs.union(more)
    discard(placed)

    # a class that links with another component shares its sure signatures with classes outside its own
    found = materialise(connected_components(links, "a", "b"))
    placed = near.join(found, F.col("class") == F.col("node"), "left").select("bucket", "class", "sure", "times", F.coalesce("component", "class").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("one"), F.max("component").alias("last")).where("one < last")
    apart = _by_bucket(placed, mixed.select("bucket"), "left_semi").groupBy("class", "sure").agg(F.sum("times").alias("total")).where("total >= sure").select("class")
    rest = _pairs(_rare_first(sets.join(materialise(apart), "class", "left_semi"), found, percent), percent)
    rest = materialise(rest.join(pairs, ["a", "b"], "left_anti"))
    links = overlaps(sets, rest, percent)

    # the last links join components
    name = lambda end: F.coalesce(F.col(f"{end}.component"), F.col(f"l.{end}"))
    a, b = (found.select("node", "component").alias(x) for x in ("a", "b"))
    joined = links.alias("l").join(a, F.col("l.a") == F.col("a.node"), "left").join(b, F.col("l.b") == F.col("b.node"), "left").select(name("a").alias("a"), name("b").alias("b"))
    merged = connected_components(joined, "a", "b").select(F.col("node").alias("old"), F.col("component").alias("new"))
    out = rows.join(found, F.col("class") == F.col("node"), "left").select("doc_id", "row", "n", F.coalesce("component", "class").alias("old"))
    return out.join(merged, "old", "left").select("doc_id", "row", "n", F.coalesce("new", "old").alias("component"))


def row_key() -> Column:
    """Tells rows apart by id and text."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def similar_documents(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (columns doc_id and text are read)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", row_key())
    rows = materialise(linked_rows(docs, percent))
    names = rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(names, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
