"""The registered queries on the smallest tables against SQL or the plain versions of the other test modules."""

import hashlib
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_licences import plain_places
from test_near_copies import survivors
from test_pii import brute_base
from test_simhash import close, components, plain_fingerprint
from test_tiling import plain_leaks

import corpus_pipeline
from compare import kind, table
from foldwise.llm import inputs, registry, toxicity

FOLDER, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return duck.execute("select doc_id, text from documents order by doc_id").fetchall()


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(registry.TOKENIZER)
    return lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")


def rows(spark, name):
    return registry.queries()[name](spark, FOLDER).collect()


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_equal_to_sql(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    found = duck.execute(registry.oracles()[name])
    columns = [d[0] for d in found.description]
    expected = found.fetchall()
    assert table(df.columns, got) == table(columns, expected)
    types = lambda cs, data: {c: {kind(r[i]) for r in data} - {None} for i, c in enumerate(cs)}
    assert types(df.columns, got) == types(columns, expected)


def test_every_dealt_operator_is_registered():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)] + ["pipeline"]
    import __spark_entry__

    assert set(names) <= set(__spark_entry__.queries())


def test_pii_query(spark, texts):
    out = {r.doc_id: r for r in rows(spark, "op1_semi_markov_pii")}
    assert len(out) == len(texts)
    for i, t in texts:
        base = brute_base(t or "")
        assert [out[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x == k for *_, x in base) for k in ("email", "ip", "card", "phone")]
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert out[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(out[i].spans.split(","))


def test_simhash_query(spark, texts):
    prints = {i: plain_fingerprint(t) for i, t in texts}
    groups = components(close(sorted(set(prints.values())), 4), set(prints.values()))
    first = {}
    for i, f in prints.items():
        first[groups[f]] = min(i, first.get(groups[f], i))
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows(spark, "op2_simhash_near_duplicates")} == {
        (i, f"{f:016x}", first[groups[f]]) for i, f in prints.items()
    }


def test_tiling_query(spark, duck, texts):
    got = {(str(r.doc_id), r.item_id, round(r.coverage, 9)) for r in rows(spark, "op4_greedy_string_tiling")}
    assert got == set(plain_leaks(duck.execute("select item_id, text from benchmark").fetchall(), texts))


def test_toxicity_query_on_held_out_labels(spark, duck):
    docs = registry.table(spark, LARGE, "documents", ["doc_id", "text"])
    labels = registry.table(spark, LARGE, "labels", ["doc_id", "toxic"])
    model = registry.toxicity_model(docs, labels.filter("doc_id % 2 = 0"))
    scored = {r.entry_id: r.rejected for r in toxicity.severity(docs, model, "doc_id", "text").collect()}
    held = [(r.doc_id, r.toxic) for r in labels.filter("doc_id % 2 = 1").collect()]
    assert np.mean([scored[i] == bool(t) for i, t in held]) > 0.97
    assert len(rows(spark, "op6_toxicity_severity")) == duck.execute("select count(*) from documents").fetchall()[0][0]


def test_token_query(spark, texts, encode):
    out = sorted(rows(spark, "op7_token_files"), key=lambda r: r.doc_id)
    start = 0
    for r, (i, t) in zip(out, texts):
        ids = encode(t)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(out) == len(texts)


def test_licence_query(spark, texts):
    out = {r.doc_id: r for r in rows(spark, "op8_licence_scan")}
    for i, t in texts:
        words, found = plain_places(t)
        at = [p for p, _ in found]
        base = sorted({label for _, label in found})
        r = out[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(base) and set(base) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_neighbour_query_recall(spark, duck):
    data = duck.execute("select vec_id, embedding from embeddings order by vec_id").fetchall()
    ids, points = np.array([i for i, _ in data]), np.array([v for _, v in data], float)
    found = {}
    for r in rows(spark, "op10_posting_lists"):
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(found) == {i for i in ids.tolist() if i % 100 == 0}
    hits = []
    for q in found:
        distance = np.sqrt(((points - points[ids == q]) ** 2).sum(axis=1))
        distance[ids == q] = np.inf
        hits.append(len(found[q] & set(ids[np.lexsort((ids, distance))[:10]].tolist())) / 10)
    assert np.mean(hits) >= 0.9


def test_pipeline_stages_against_plain_versions(spark, duck, encode):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], FOLDER).cache()
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        kept.append(out)
    read = [{r.doc_id: r.text for r in d.collect()} for d in kept]
    whole = {r.doc_id: r for r in docs.collect()}
    assert all(t == whole[i].text for texts in read for i, t in texts.items())
    model = registry.toxicity_model(docs, registry.table(spark, FOLDER, "labels", ["doc_id", "toxic"]))
    toxic = {r.entry_id for r in toxicity.severity(docs, model, "doc_id", "text").filter("rejected").collect()}
    assert read[1].keys() == read[0].keys() - toxic and toxic
    assert sorted(read[2]) == survivors(read[1].items())
    leaking = {int(i) for i, *_ in plain_leaks(duck.execute("select item_id, text from benchmark").fetchall(), read[2].items())}
    assert read[3].keys() == read[2].keys() - leaking
    words = {i: len(t.encode().split()) for i, t in read[3].items()}
    assert 0.85 * sum(words.values()) <= sum(words[i] for i in read[4]) <= sum(words.values()) and read[4].keys() < read[3].keys()
    out = sorted(registry.queries()["pipeline"](spark, FOLDER).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in out] == sorted(read[4])
    start = 0
    for r in out:
        ids = encode(read[4][r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_stages_bear_awkward_documents(spark, awkward, tmp_path):
    texts = [*enumerate(awkward), (3, "again"), (3, "again"), (None, "no id"), (None, None)]
    clashing = ["bucket", "text_key", "_chosen", "chosen_0", "Kept_ID_0", "node", "entry_id", "component", "item_id"]
    wide = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in clashing)
    data = [(i, t, None if n % 3 else "en", None if n % 4 else f"src{n}", None, *["x"] * len(clashing)) for n, (i, t) in enumerate(texts)]
    frame = spark.createDataFrame(data, wide)
    for rows_of in (frame, frame.limit(0)):
        folder = str(tmp_path / f"t{rows_of.count()}")
        rows_of.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, None, 0), (None, 1, 1), (5, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, None), (2, ""), (None, "x")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        assert len(out) <= rows_of.count() and (len(out) > 8 or not rows_of.count())
        for name in ("op1_semi_markov_pii", "op2_simhash_near_duplicates", "op5_substring_dedup", "op7_token_files", "op8_licence_scan", "op6_toxicity_severity"):
            assert registry.queries()[name](spark, folder).count() == rows_of.count(), name


@pytest.mark.parametrize("absent", ["public_tokenizers", "xxhash", "corpus_pipeline", "foldwise.llm"])
def test_other_queries_work_without(absent):
    """The driver's entry still imports where the subpackage or a library of its own is missing."""
    import subprocess
    import sys

    code = f"import sys; sys.modules[{absent!r}] = None\nimport __spark_entry__ as e\nprint(len(e.queries()), any(n.startswith('op1') for n in e.queries()))"
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], capture_output=True, text=True, cwd=str(__import__("pathlib").Path(__file__).parents[2]))
    assert done.returncode == 0, done.stderr
    count, present = done.stdout.split()
    assert int(count) > 200 and present == "False"


@pytest.mark.parametrize("stage", ["toxicity", "near_duplicates", "decontamination", "token_files"])
def test_whole_texts_reach_the_workers_of_a_stage_in_batches_of_bounded_bytes(spark, stage):
    name, texts = "spark.sql.execution.arrow.maxBytesPerBatch", spark.range(6000).select(F.repeat(F.lit("x"), 2000)).coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(20)
    spark.conf.unset(name)
    try:
        dict(corpus_pipeline.STAGES)[stage](spark, docs, FOLDER)
        assert max(r.size for r in texts.mapInArrow(sizes, "size bigint").collect()) < 2 * inputs.BATCH_BYTES
        spark.conf.set(name, "1000000")
        dict(corpus_pipeline.STAGES)[stage](spark, docs, FOLDER)
        assert spark.conf.get(name) == "1000000"
    finally:
        spark.conf.unset(name)


def test_the_whole_pipeline_leaves_the_session_as_it_was(spark, monkeypatch):
    seen, name = [], inputs.BATCH_SETTING
    spy = lambda spark, docs, sf_dir: seen.append(spark.conf.get(name, None)) or docs
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", corpus_pipeline.in_small_batches(spy)), ("b", spy)])
    spark.conf.unset(name)
    corpus_pipeline.run(spark, FOLDER)
    assert seen == [str(inputs.BATCH_BYTES)] * 2 and spark.conf.get(name, None) is None
