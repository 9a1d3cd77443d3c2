"""One query per operator over the whole of its table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refscope.llm import (
    decontam,
    extract,
    licenses,
    linededup,
    periodic,
    pieces,
    quality,
    resample,
    simhash,
    tokencounts,
    toolcalls,
    topk,
    urlfilter,
)
from refscope.llm.common import let
from refscope.runtime import own_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Where the public vocabulary files lie; only the driver reads them.
TOKENIZERS = "/opt/tokenizers"
PIECE_MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"

URL_RULES = [
    urlfilter.Rule("allow", "org", "/"),
    urlfilter.Rule("block", "example.org", "/es/"),
    urlfilter.Rule("block", "example.org", "/en/1"),
    urlfilter.Rule("allow", "com", "/fr/"),
    urlfilter.Rule("block", "com", "/de/"),
]
TOOL_SCHEMAS = {
    "answer": {
        "type": "object",
        "properties": {
            "question": {"type": "string", "minLength": 1, "maxLength": 400},
            "turn": {"type": "integer", "minimum": 0},
        },
        "required": ["question", "turn"],
        "additionalProperties": False,
    }
}
LINE_WORDS = 50
WINDOW_WORDS = 10
SIMHASH_SHINGLE, SIMHASH_DISTANCE = 4, 4


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after all documents came in, all but English ones were counted anew, and later copies went."""
    first, second = "byte_bpe_50k", "byte_bpe_multi_50k"
    files = {name: f"{TOKENIZERS}/{name}.tiktoken" for name in (first, second)}
    docs = table(spark, sf_dir, "documents")
    again = F.coalesce(F.col("lang") != "en", F.lit(False))
    rows = tokencounts.counted(docs, files, F.when(again, F.array(F.lit(first), F.lit(second))).otherwise(F.array(F.lit(first))))
    old, new = (F.lit(first), F.col(first)), (F.lit(second), F.col(second))
    now = (F.when(again, second).otherwise(first), F.when(again, F.col(second)).otherwise(F.col(first)))
    kept = rows.groupBy("copy").agg(F.min("doc_id").alias("kept"))
    late = rows.join(kept, "copy").where("doc_id > kept")
    rollup = tokencounts.Rollup(spark, own_folder(spark, "rollup"))
    rollup.commit("load", tokencounts.event("insert", rows, old, None))
    rollup.commit("recount", tokencounts.event("revise", rows.where(again), new, old))
    rollup.commit("copies", tokencounts.event("delete", late, None, now))
    # A batch that comes twice counts once.
    rollup.commit("load", tokencounts.event("insert", rows, old, None))
    return rollup.totals()


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by rule, else by list: an address is listed if any page has it with a campaign mark."""
    pages = table(spark, sf_dir, "pages")
    host, path = urlfilter.split_url(F.col("url"))
    marked = F.coalesce(F.col("url").contains("utm_source="), F.lit(False))
    keys = pages.select(F.concat(host, path).alias("key"), marked.alias("listed"))
    cascade = urlfilter.build_cascade(keys, "key", "listed")
    return urlfilter.judged(pages, URL_RULES, "concat(host, path)", cascade)


@query
def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as calls and results: a user's turn calls ``answer``, the next assistant's turn is its result."""
    turns = table(spark, sf_dir, "conversations")
    turn, before = F.col("turn").cast("string"), (F.col("turn") - 1).cast("string")
    user, reply = F.col("role") == "user", F.col("role") == "assistant"
    items = turns.select(
        "conv_id",
        "turn",
        F.when(user, "call").when(reply, "result").otherwise("message").alias("kind"),
        F.concat(F.when(user, "c").otherwise("r"), turn).alias("id"),
        F.when(user, F.concat(F.lit("r"), before)).alias("parent_id"),
        F.when(reply, F.concat(F.lit("c"), before)).alias("call_id"),
        F.when(user, "answer").alias("name"),
        F.when(user, F.to_json(F.struct(F.col("turn"), F.col("text").alias("question")))).alias("arguments"),
        "role",
        F.col("text").alias("content"),
    )
    return toolcalls.linked(items, TOOL_SCHEMAS).withColumn("errors", F.array_join("errors", "; "))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.without_repeats(table(spark, sf_dir, "documents"), LINE_WORDS)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = pieces.Tokenizer(spark, pieces.load(PIECE_MODEL))
    coded = table(spark, sf_dir, "documents").select("doc_id", "text", tokenizer.coded(F.col("text")).alias("coded"))
    return coded.select(
        "doc_id",
        F.size("coded.ids").cast("long").alias("n_pieces"),
        F.xxhash64("coded.ids").alias("ids_hash"),
        F.sha2("coded.decoded", 256).alias("decoded_sha256"),
        F.col("text").eqNullSafe(F.col("coded.decoded")).alias("round_trip"),
    )


@query
def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), SIMHASH_SHINGLE, SIMHASH_DISTANCE)
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select("doc_id", "held_out", "score", "predicted")


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree by source, language and hundreds; every 20th is its directory's license file."""
    name = F.when(F.col("doc_id") % 20 == 0, "LICENSE").otherwise(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")))
    hundred = F.floor(F.col("doc_id") / 100).cast("string")
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang", hundred, name).alias("path"), "text")
    found = licenses.scan(files)
    return found.select("row.doc_id", "path", "own_license", "score", "license", "inherited_from")


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), WINDOW_WORDS
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of whole documents; by a hash of the id, a tenth of these first gets a part that repeats."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")

    def repeating(w: Column) -> Column:
        g = F.floor(h / 10).cast("long")
        a = (g % F.size(w)).cast("int")
        p = (F.lit(1) + F.floor((F.size(w) - a) / (F.lit(3) + g % 8))).cast("int")
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + (i - a) % p))), " ")

    planted = F.when(h % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, repeating(w)))).otherwise(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", planted.alias("text"))
    found = periodic.periodic_runs(docs, F.col("text"))
    most = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"], r["period"])))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    found = found.withColumn("most", most)
    return found.select(
        "row.doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("most.start").alias("start"),
        (-F.col("most.n")).alias("length"),
        F.col("most.period").alias("period"),
        F.expr("(-most.n * 1000) div most.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = resample.weighed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return resample.drawn(weights).select("doc_id", "n_features", "weight", "score", "rank")


@query
def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = extract.extracted(pages, F.col("html"), extract.fitted(pages, F.col("html")))
    return found.select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))
