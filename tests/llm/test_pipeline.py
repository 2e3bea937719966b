"""Each stage of the pipeline on its own input, against brute force."""

import hashlib
import itertools
import os
import re

import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"

import corpus_pipeline as pipeline
from loomline.llm import common, toxicity
from loomline.llm.queries import QUERIES, TOKENIZER, vocabulary
from test_corpus import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage returned, read again from Parquet."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs)
    return out


def rows(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_columns_stay(kept):
    for df in kept[1:-1]:
        assert df.columns == kept[0].columns
    assert kept[-1].columns[: len(kept[0].columns)] == kept[0].columns


def test_toxic_documents_go(spark, kept):
    docs = kept[0]
    model, beta = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), common.fold("doc_id", 5) != 0)
    rejected = {r["doc_id"] for r in toxicity.score(docs, model, beta).where("predicted = 1").collect()}
    assert [r[0] for r in rows(kept[1])] == sorted({r[0] for r in rows(docs)} - rejected)


def test_copies_go(kept):
    groups = {}
    for i, t in rows(kept[1]):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i))
    assert [r[0] for r in rows(kept[2])] == sorted(min(g)[1] for g in groups.values())


def test_near_copies_go(kept):
    before, after = rows(kept[2]), {i for i, _ in rows(kept[3])}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.encode().lower().split()) else set() for i, t in before}
    best = {i: 0.0 for i in sets}
    for i, j in itertools.combinations(sets, 2):
        if sets[i] and sets[j] and len(sets[i]) >= 0.6 * len(sets[j]) >= 0.36 * len(sets[i]):
            x = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            best[i], best[j] = max(x, best[i]), max(x, best[j])
            assert x < 0.85 or not (i in after and j in after), (i, j, x)
    assert all(best[i] > 0.72 for i in sets if i not in after)


def test_contaminated_documents_go(spark, kept):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    marks = {t.lower()[:30] for _, t in items}
    before = rows(kept[3])
    # the brute force compares all windows, so it is asked about short documents and those that look touched
    asked = [(i, t) for i, t in before if len(t) < 600 or any(m in t.lower() for m in marks)][:60]
    after = {i for i, _ in rows(kept[4])}
    for i, t in asked:
        assert (i not in after) == brute(t, items)[-1], i
    assert after <= {i for i, _ in before} and len(after) > 0.5 * len(before)


def test_encoding(kept):
    import tokenizers

    lib = tokenizers.Tokenizer.from_file(vocabulary(TOKENIZER))
    for r in kept[5].collect():
        ids = lib.encode(r["text"], add_special_tokens=False).ids
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_applies_all_stages(spark, kept):
    assert rows(pipeline.run(spark, SF)) == rows(kept[5])


def test_queries_return_their_columns(spark):
    want = {
        1: "doc_id start n_tokens ids_crc32", 2: "doc_id n_words n_hit n_items items_sha256 contaminated", 3: "doc_id held_out score predicted", 4: "doc_id n_tokens ids_sha256 decoded_sha256",
        5: "doc_id held_out lang_pred score", 6: "doc_id keep_id group_size kept text_sha256", 7: "page_id url text n_chars", 9: "doc_id held_out n_tokens n_known train_tokens base_score score",
        10: "doc_id fingerprint component_id",
    }
    named = {int(n[2:].split("_")[0]): f for n, f in QUERIES.items()}
    assert sorted(named) == list(range(1, 11))
    for n, columns in want.items():
        if n not in (3, 9):  # run by their own tests
            assert named[n](spark, SF).columns[: len(columns.split())] == columns.split()


def test_stages_are_empty_for_an_empty_table(spark, kept):
    docs = kept[0].where("doc_id < 0")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_workers_of_a_stage_get_small_batches(spark):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    def largest():
        got = [r["n"] for r in spark.range(0, 2500, 1, 1).mapInArrow(sizes, "n long").collect()]
        assert sum(got) == 2500
        return max(got)

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    none = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    try:
        for _, stage in pipeline.STAGES:
            spark.conf.set(key, "10000")
            stage(spark, none, SF)
            assert largest() == common.BATCH
        for held, most in (("0", common.BATCH), ("7", 7)):  # no bound, and a lower one of the user
            spark.conf.set(key, held)
            common.small_batches(spark)
            assert largest() == most
    finally:
        spark.conf.set(key, before)
