"""The registered query of each operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import maintext, manifest, periodic
from .decontam import contaminated
from .jaccard import similar_documents
from .lmscore import score_texts
from .packing import pack_documents
from .quality import fit_quality, score_quality
from .rules import apply_rules, fit_rules
from .secrets import find_secrets
from .substring import remove_repeats
from .toxicity import fit_toxicity, score_toxicity
from .warc import derivatives, responses


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, _read(spark, sf_dir, "labels")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, _read(spark, sf_dir, "labels")))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(_read(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_read(spark, sf_dir, "documents")).drop("kept")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_read(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path())


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_read(spark, sf_dir, "documents")).drop("base_spans")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return apply_rules(docs, fit_rules(docs, _read(spark, sf_dir, "labels")))


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(_read(spark, sf_dir, "pages")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    made = manifest.build(manifest.leaves(_read(spark, sf_dir, "documents"), altered))
    return manifest.verified(manifest.proofs(made))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return maintext.extract(pages, maintext.fit_extractor(pages)).drop("blocks")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(_read(spark, sf_dir, "documents"), copied=periodic.copied_stretch)
    return found.drop("n_words", "runs", "collapsed")


QUERIES = {
    "op2_quality_classifier": op2_quality_classifier,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_toxicity": op4_toxicity,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op6_warc_derivatives": op6_warc_derivatives,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_secret_scans": op8_secret_scans,
    "op9_quality_rules": op9_quality_rules,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_html_extraction": op12_html_extraction,
    "op13_periodic_runs": op13_periodic_runs,
}


def _merkle_sql(levels: int = 7, above: int = 4) -> str:
    """op11 for at most 16 ** levels documents of a source and 16 ** above sources: all levels written out, nothing regenerated."""
    def digest(text: str) -> str:
        columns = [f"coalesce(octet_length(encode({c}::varchar))::varchar || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(columns)})"

    def climb(name: str, start: str, count: int) -> list[str]:
        out = [f"{name}0 as ({start})"]
        for k in range(count):
            out.append(f"{name}{k + 1} as (select tree, pos // 16 as pos, case when total = 1 then min(d) else sha256(string_agg(d, '' order by pos)) end as d, (total + 15) // 16 as total from {name}{k} group by tree, pos // 16, total)")
            out.append(f"{name}g{k} as (select tree, pos // 16 as grp, total, list(d order by pos) as ds from {name}{k} group by tree, pos // 16, total)")
        return out

    def way(name: str, levels_of: str, start: str, tree: str, count: int) -> list[str]:
        out = [f"{name}0 as ({start})"]
        for k in range(count):
            at = f"(f.pos // {16**k})"
            left, right = f"array_to_string(g.ds[1:{at} % 16], '')", f"array_to_string(g.ds[{at} % 16 + 2:], '')"
            out.append(
                f"{name}{k + 1} as (select f.* exclude (proof, fold), case when g.total = 1 then f.proof else f.proof || {left} || {right} end as proof, "
                f"case when g.total = 1 then f.fold else sha256({left} || f.fold || {right}) end as fold from {name}{k} f join {levels_of}g{k} g on g.tree = f.{tree} and g.grp = {at} // 16)"
            )
        return out

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = "case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end"
    parts = [
        f"steps as (select list(v order by i) as t from (select i, list_reduce(list_prepend(i, range(8)), lambda a, b: {step}) as v from range(256) r(i)))",
        "crc as (select doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) as crc from (select distinct doc_id from documents), steps)",
        f"leaves as (select doc_id, coalesce('=' || source, '') as tree, {digest('text')} as leaf, case when crc % 5 = 0 then {digest(lower)} else {digest('text')} end as altered from documents left join crc using (doc_id))",
        "placed as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as total from leaves)",
        *climb("n", "select tree, pos, leaf as d, total from placed", levels),
        f"subroots as (select tree, d as subroot, row_number() over (order by tree) - 1 as top, count(*) over () as total from n{levels})",
        *climb("s", "select '' as tree, top as pos, subroot as d, total from subroots", above),
        *way("w", "n", "select *, '' as proof, altered as fold from placed", "tree", levels),
        *way("v", "s", f"select w.doc_id, w.leaf, w.proof, w.fold, s.subroot, s.top as pos, '' as top from w{levels} w join subroots s using (tree)", "top", above),
    ]
    return f"with {', '.join(parts)} select doc_id, leaf, subroot, s.d as root, sha256(proof) as proof_sha256, fold as folded_root, fold = s.d as verified from v{above}, s{above} s"


#: The other operators are models, packings, tokenizers' work or searches that SQL can't say or is too slow for: they have brute-force tests.
ORACLE_SQL: dict[str, str] = {"op11_merkle_manifest": _merkle_sql()}
