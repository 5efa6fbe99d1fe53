"""Trained operators: held-out accuracy, and rows that must not break them."""

import gzip
import io
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import quality, rules, warc
from ledgerloom.llm.labelled import labelled_sample
from ledgerloom.llm.quality import fit_quality, score_quality
from ledgerloom.llm.rules import RuleModel, apply_rules, fit_rules
from ledgerloom.llm.textbatch import rolling
from ledgerloom.llm.toxicity import ToxicityModel, fit_toxicity, score_toxicity
from ledgerloom.llm.warc import derivatives, digest, page_text, read_responses, responses, write_warc

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache(), spark.read.parquet(f"{SF}/labels.parquet").cache()


def _held(rows, labels, label):
    joined = rows.where("held_out").join(labels.groupBy("doc_id").agg(F.max(label).alias("y")), "doc_id").toPandas()
    return joined["predicted"], joined["y"]


def test_quality(tables):
    docs, labels = tables
    out = score_quality(docs, fit_quality(docs, labels))
    p, y = _held(out, labels, "quality")
    assert (p == y).mean() > 0.95 and p[y == 1].mean() > 0.97 and p[y == 0].mean() < 0.2 and out.count() == docs.count()
    assert out.where("score is null or score < 0 or score > 1").count() == 0


def test_records_are_read_as_far_as_a_file_goes():
    record = lambda kind, block: b"WARC/1.1\r\nWARC-Type: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, len(block), block)
    blocks = [b"HTTP/1.1 200 OK\r\n\r\n<p>x\r\n\r\n", b"", b"y" * 300_000, b"z"]
    plain = [record(b"response", x) for x in blocks]
    read = lambda data, zipped: [b for _, b in warc._records(io.BufferedReader(warc._Unzipped(io.BytesIO(data))) if zipped else io.BytesIO(data))]
    assert read(b"".join(plain), False) == blocks and read(b"".join(plain)[:-6], False) == blocks[:-1]
    for zipped in (gzip.compress(b"".join(plain)), b"".join(gzip.compress(x) for x in plain)):
        assert read(zipped, True) == blocks and read(zipped + b"\0\0rest", True) == blocks
    assert read(b"".join(gzip.compress(x) for x in plain)[:-12], True) == blocks[:-1] and read(b"", False) == []


def test_words_in_a_row_are_not_quality(spark):
    """One word many times, words of a good text each a few times in a row, and the text itself; with as many labels as show such texts."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = fit_quality(docs, labels)
    good = docs.join(labels.where("quality = 1"), "doc_id").where("n_chars between 800 and 3000").orderBy("doc_id").limit(5).collect()
    words = [w for r in good for w in r["text"].split()[:4]]
    rows = [(i, f"{w} " * 300) for i, w in enumerate(words)] + [(100 + i, " ".join(w for w in r["text"].split() for _ in range(4))) for i, r in enumerate(good)] + [(200 + i, r["text"]) for i, r in enumerate(good)]
    score = {r["doc_id"]: r["score"] for r in score_quality(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert max(v for k, v in score.items() if k < 200) < 0.3 < min(v for k, v in score.items() if k >= 200)


def test_toxicity(tables):
    docs, labels = tables
    p, y = _held(score_toxicity(docs, fit_toxicity(docs, labels)), labels, "toxic")
    assert (p == y).mean() > 0.9 and p[y == 0].mean() < 0.03


def _auc(y, score):
    rank = score.rank()
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_quality_rules(tables):
    docs, labels = tables
    out = apply_rules(docs, fit_rules(docs, labels)).join(labels, "doc_id").toPandas()
    assert out[out["quality"] == 1]["kept"].mean() > 0.93 and out[out["quality"] == 0]["kept"].mean() < 0.1
    held = out[[zlib.crc32(str(i).encode()) % 5 == 0 for i in out["doc_id"]]]
    assert _auc(held["quality"], held["score"]) > 0.95
    assert (out["kept"] == (~out["base_failed"] & (out["score"] >= 0.3))).all()


def test_rule_scores_by_hand():
    """The score of a text is a logistic function of means of its n-grams' weights."""
    rng = np.random.default_rng(1)
    model = RuleModel(rng.normal(0, 1, rules.ROWS), -0.3, 0.7, 0.1)
    for text in (b"a b a b. A Ab", b"", b"x", "é è\n\tz".encode()):
        words = [xxhash.xxh3_64_intdigest(w.lower()) for w in text.split()]
        grams = [
            [h % rules.WORD_ROWS for h in words],
            [rules.WORD_ROWS + int(rolling(np.array(words[i : i + 2], np.uint64), 2)[0]) % rules.PAIR_ROWS for i in range(len(words) - 1)],
            [rules.WORD_ROWS + rules.PAIR_ROWS + ((int.from_bytes(text[i : i + 3], "big") * 2654435761 % 2**32) >> 18) for i in range(len(text) - 2)],
            [rules.ROWS - 256 + sum(2**k for k in range(8) if i > k and words[i - k - 1] == h) for i, h in enumerate(words)],
        ]
        z = -0.3 + sum(np.mean([model.weights[r] for r in g]) for g in grams if g)
        assert model.probabilities([text])[0] == pytest.approx(1 / (1 + np.exp(-(0.7 * z + 0.1))))


def test_toxicity_scores_by_hand():
    """Bias, linear part and every pair of terms, one by one."""
    rng = np.random.default_rng(2)
    terms = [xxhash.xxh3_64_intdigest(w) for w in (b"you", b"awful", b"people")] + [xxhash.xxh3_64_intdigest(b"peop", seed=4)]
    model = ToxicityModel(np.sort(np.array(terms, np.uint64)), 0.2, rng.normal(0, 1, 4), rng.normal(0, 1, (4, 3)), 1.5)
    x = {terms[0]: 1 + np.log(2), terms[1]: 1.0, terms[2]: 1.0, terms[3]: 1.0}
    at = {t: int(np.searchsorted(model.known, np.uint64(t))) for t in terms}
    z = 0.2 + sum(model.linear[at[t]] * v for t, v in x.items())
    z += sum(model.factors[at[s]] @ model.factors[at[t]] * x[s] * x[t] for i, s in enumerate(terms) for t in terms[:i])
    assert model.probabilities([b"You, awful people! YOU know"])[0] == pytest.approx(1 / (1 + np.exp(-z / 1.5)))
    assert model.probabilities([b""])[0] == pytest.approx(1 / (1 + np.exp(-0.2 / 1.5)))


def test_quality_scores_by_hand():
    """Pooled vectors, norms and length under two layers, word by word."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(0, 1, (quality.ROWS, quality.DIM)).astype(np.float32)
    text = b"The cat, the CAT 12 times!"
    entries = [(quality._Entries()[w] >> 16, quality._Entries()[w] & 0xFFFF) for w in text.split()]
    a, b = (np.mean([vectors[e[k]] for e in entries], axis=0) for k in (0, 1))
    unit = [vectors[e[0]] / np.linalg.norm(vectors[e[0]]) for e in entries]
    near = [np.mean([u @ v for u, v in zip(unit, unit[gap:], strict=False)]) for gap in (1, 2)]
    x = np.concatenate([a, b, near, [np.linalg.norm(a), np.linalg.norm(b), np.log(7)]])
    assert quality.pool([b"other words", text], vectors)[1] == pytest.approx(x, rel=1e-4)
    w1, w2 = rng.normal(0, 1, (len(x), 5)), rng.normal(0, 1, 5)
    model = quality.QualityModel(vectors, x * 0 + 0.1, x * 0 + 2, w1, w2, w2, 0.3, 1.7)
    z = np.maximum(((x - 0.1) / 2) @ w1 + w2, 0) @ w2 + 0.3
    assert model.probabilities([text])[0] == pytest.approx(1 / (1 + np.exp(-z / 1.7)), rel=1e-4)


def test_long_texts_are_fitted_and_weights_follow_the_documents(spark):
    docs = spark.createDataFrame([(i, ("good text " if i % 2 else "bad stuff ") * (9000 if i < 12 else 3)) for i in range(1, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 200)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    sample = labelled_sample(docs, labels, "quality", per_class=10).toPandas()
    known = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 5]
    assert set(sample["doc_id"]) <= set(known) and (sample["text"].str.len() > 60_000).any()
    assert all(w == pytest.approx(max(1, sum(k % 2 == y for k in known) / 10)) for y, w in zip(sample["label"], sample["weight"], strict=True))


@pytest.mark.parametrize("none", ["empty", "one class", "null"])
def test_odd_rows_and_labels(spark, odd_docs, empty_docs, none):
    rows = {"empty": [], "one class": [(i, 1, 0) for i in range(40)], "null": [(None, 1, 1), (3, None, None), (4, 1, 1), (4, 0, 0), (6, 0, 1), (6, 0, 1)]}[none]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    n = odd_docs.count()
    for fit, score, column in ((fit_quality, score_quality, "predicted"), (fit_toxicity, score_toxicity, "predicted"), (fit_rules, apply_rules, "kept")):
        model = fit(odd_docs, labels)
        got = score(odd_docs, model).toPandas()
        assert len(got) == n and got["score"].between(0, 1).all() and got[column].notna().all()
        assert score(empty_docs, model).count() == 0


def test_labels_are_never_inputs(tables):
    docs, labels = tables
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (score_quality(docs, fit_quality(docs, x)).orderBy("doc_id").toPandas()["score"] for x in (labels, flipped))
    assert np.array_equal(a, b)


def test_warc(spark, tmp_path):
    html = "<html><head><title>T</title><script>x('</p>')</script></head><body><h1>Hé &amp; llo</h1><p>a  b<br>c</p><style>p{}</style><p>d</body></html>"
    assert page_text(html) == "Hé & llo\na b\nc\nd"
    pages = spark.createDataFrame([(1, "http://a/x y", html, "z"), (2, None, None, "z"), (3, "http://b", "", "z"), (None, "http://c", "<p>unclosed <b>x", "z"), (1, "http://a/x y", html, "z"), (5, "http://d", "<p>" + "long " * 50_000, "z")], "page_id long, url string, html string, record_id string")
    source = {r["record_id"]: r for r in responses(pages).collect()}
    records = derivatives(responses(pages)).collect()
    assert len(records) == 12 and {r["record_type"] for r in records} == {"metadata", "conversion"}
    for r in records:
        head, _, block = r["record"].partition("\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.split("\r\n")[1:])
        assert fields["WARC-Refers-To"] == r["refers_to"] and r["refers_to"] in source and fields["WARC-Block-Digest"] == digest(block.encode()) and int(fields["Content-Length"]) == len(block.encode())
        assert fields["WARC-Refers-To-Payload-Digest"] == digest(source[r["refers_to"]]["payload"].encode())
        if r["record_type"] == "metadata":
            assert f"sourceRecord: {r['refers_to']}" in block and "sourceHeader: Content-Type: text/html; charset=utf-8" in block
    write_warc(derivatives(responses(pages.where("page_id = 1"))).coalesce(1), f"{tmp_path}/w", "none")
    raw = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("part-*"))
    at, found = 0, 0
    while at < len(raw):
        head = raw[at : raw.index(b"\r\n\r\n", at)]
        size = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        at += len(head) + 4 + size
        assert head.startswith(b"WARC/1.1\r\n") and raw[at : at + 4] == b"\r\n\r\n"
        at += 4
        found += 1
    assert found == 4
    assert derivatives(responses(pages.limit(0))).collect() == []


def test_responses_are_read_from_files(spark, tmp_path):
    def record(kind, rid, block, *more):
        head = "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{rid}>", "WARC-Date: 2020-02-02T00:00:00Z", *more, f"Content-Length: {len(block)}"])
        return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    html = "<p>é one</p>".encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    response = record("response", "r1", http + html, "WARC-Target-URI: http://x/1", "WARC-Payload-Digest: sha1:KEPT")
    other = record("response", "r2", http + b"<p>two\r\n\r\nWARC/1.0 in the text</p>", "WARC-Target-URI: http://x/2")
    (tmp_path / "a.warc").write_bytes(record("warcinfo", "i", b"software: x") + response)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record("request", "q", b"GET /")) + gzip.compress(other) + gzip.compress(other[:60]))
    got = {r["record_id"]: r for r in read_responses(spark, f"{tmp_path}/*.warc*").collect()}
    assert {k: (r["target_uri"], r["payload"]) for k, r in got.items()} == {"<urn:uuid:r1>": ("http://x/1", "<p>é one</p>"), "<urn:uuid:r2>": ("http://x/2", "<p>two\r\n\r\nWARC/1.0 in the text</p>")}
    made = {(r["refers_to"], r["record_type"]): r for r in derivatives(read_responses(spark, f"{tmp_path}/*.warc*")).collect()}
    assert made["<urn:uuid:r1>", "conversion"]["payload_digest"] == "sha1:KEPT" and made["<urn:uuid:r1>", "conversion"]["block"] == "é one" and "sourceHeader: Content-Type: text/html" in made["<urn:uuid:r1>", "metadata"]["block"]
    assert made["<urn:uuid:r2>", "metadata"]["payload_digest"] == digest(b"<p>two\r\n\r\nWARC/1.0 in the text</p>")


@pytest.mark.parametrize("html, text", [
    ("<html><head><title>T</title><meta charset=x><body><h1>A</h1><p>b", "A\nb"),
    ("<head><title>T</title><p>a<p>b", "a\nb"),
    ("<head><title>T</title><style>p{}</style> plain <b>text</b>", "plain text"),
    ("<head><title>T</title><noscript><link rel=x><body><p>a</p>", "a"),
    ("<head></head><body><p>a</p><noscript><p>b</p><p>c</p>", "a\nb\nc"),
    ("<body><p>a</p><template><p>b</p>", "a\nb"),
    ("<head><noscript><p>x</p></noscript></head><body><p>a</p><template><p>b</p></template><noscript>c</noscript><p>d<script>var e", "a\nd"),
])
def test_page_text_with_omitted_end_tags(html, text):
    assert page_text(html) == text
