import random
from collections import Counter

import pytest

from refscope.llm import queries as Q
from refscope.llm import tokencounts as T

EVENT = "op string, source string, lang string, tokenizer string, tokens long, old_source string, old_lang string, old_tokenizer string, old_tokens long"


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in rollup.totals().collect()}


def test_deltas_equal_a_count_of_what_is_there(spark, tmp_path):
    rng = random.Random(1)
    state, rollup = {}, T.Rollup(spark, str(tmp_path / "r"))
    assert totals(rollup) == {}
    for batch in range(4):
        events = []
        for _ in range(120):
            i = rng.randrange(80)
            new = (rng.choice(["a", "b", None]), rng.choice(["en", None]), rng.choice(["t1", "t2"]), rng.choice([0, 5, 11]))
            if i not in state:
                events.append(("insert", *new, None, None, None, None))
                state[i] = new
            elif rng.random() < 0.4:
                events.append(("delete", None, None, None, None, *state.pop(i)))
            else:
                events.append(("revise", *new, *state[i]))
                state[i] = new
        df = spark.createDataFrame(events, EVENT)
        assert rollup.commit(f"b{batch}", df)
        assert not rollup.commit(f"b{batch}", df)
        docs, tokens = Counter(), Counter()
        for s, lang, t, n in state.values():
            docs[s, lang, t] += 1
            tokens[s, lang, t] += n
        assert totals(rollup) == {k: (docs[k], tokens[k]) for k in docs}
    assert totals(T.Rollup(spark, str(tmp_path / "r"))) == totals(rollup)


def test_a_batch_that_died_is_written_anew(spark, tmp_path):
    rollup = T.Rollup(spark, str(tmp_path))
    df = spark.createDataFrame([("insert", "s", "l", "t", 3, None, None, None, None)], EVENT)
    rollup.commit("one", df)
    (tmp_path / "batch=one" / "_SUCCESS").unlink()
    assert totals(rollup) == {} and rollup.commit("one", df) and totals(rollup) == {("s", "l", "t"): (1, 3)}


def test_edge_cases(spark, tmp_path):
    rollup = T.Rollup(spark, str(tmp_path))
    none = spark.createDataFrame([], EVENT)
    assert rollup.commit("none", none) and totals(rollup) == {}
    df = spark.createDataFrame([("insert", None, None, None, None, None, None, None, None)] * 2, EVENT)
    rollup.commit("nulls", df)
    assert totals(rollup) == {(None, None, None): (2, 0)}
    with pytest.raises(Exception, match="unknown op"):
        rollup.commit("bad", spark.createDataFrame([("upsert", *[None] * 8)], EVENT))
    with pytest.raises(ValueError, match="named by"):
        rollup.commit("a/b", none)


def test_query_equals_a_plain_count(spark):
    import tiktoken

    sf = "/root/testdata/sf0.001"
    coders = {}
    for name in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        import base64

        with open(f"{Q.TOKENIZERS}/{name}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coders[name] = tiktoken.Encoding(name, pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        first.setdefault(r.text, r.doc_id)
    want = {}
    for r in rows:
        if first[r.text] == r.doc_id:
            name = "byte_bpe_50k" if r.lang == "en" else "byte_bpe_multi_50k"
            docs, tokens = want.get((r.source, r.lang, name), (0, 0))
            want[r.source, r.lang, name] = (docs + 1, tokens + len(coders[name].encode_ordinary(r.text)))
    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in Q.op2_token_counts(spark, sf).collect()}
    assert got == want


def test_counts_of_odd_texts(spark, docs):
    from pyspark.sql import functions as F

    rows = [(1, None), (2, ""), (3, "<|endoftext|>"), (4, "a" * 200_000), (4, " " * 50_000)]
    found = docs(rows).select("text", T.token_count(spark, F.col("text"), f"{Q.TOKENIZERS}/byte_bpe_50k.tiktoken").alias("t")).collect()
    got = {r.text: r.t for r in found}
    assert got[None] is None and got[""] == 0 and got["<|endoftext|>"] > 1 and got["a" * 200_000] > 1000
