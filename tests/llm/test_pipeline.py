import pytest
import zstandard
from test_duplicates import brute_lines, plain_fingerprint, roots_of
from test_models_and_benchmark import brute

import corpus_pipeline as cp
from frostline.llm import compression_bands as cb
from frostline.llm import hilbert_packing as hp
from frostline.llm import workspace
from frostline.llm.queries import tokenizer
from frostline.llm.workspace import saved

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in cp.STAGES:
        out.append((name, saved(stage(spark, out[-1][1], SF), "stage")))
    return dict(out)


def test_stages_return_documents(stages):
    columns = stages["documents"].dtypes
    for name, _ in cp.STAGES[:-1]:
        assert stages[name].dtypes == columns


def test_each_stage_keeps_part_of_what_it_gets(stages):
    names = ["documents", *[n for n, _ in cp.STAGES[:-1]]]
    for before, after in zip(names, names[1:]):
        ids = {r.doc_id for r in stages[before].select("doc_id").collect()}
        kept = [r.doc_id for r in stages[after].select("doc_id").collect()]
        assert set(kept) <= ids and len(kept) == len(set(kept)) > len(ids) / 2


def test_near_dedup_leaves_one_of_equal_texts(spark, stages):
    texts = [r.text for r in stages["near dedup"].collect()]
    assert len(texts) == len(set(texts))
    gone = {r.text for r in stages["line dedup"].collect()} - set(texts)
    assert len(gone) < 0.2 * len(texts)


def test_packing_holds_every_id_once(stages):
    codec = hp.tokens_of(tokenizer()).codec
    want = sum(len(codec.encode(r.text, add_special_tokens=False).ids) + 1 for r in stages["decontamination"].collect())
    assert stages["packing"].agg({"length": "sum"}).first()[0] == want


def test_run_gives_the_rows_of_the_last_stage(spark, stages):
    columns = ["doc_id", "start", "length", "ids_crc32"]
    got = sorted(cp.run(spark, SF).select("doc_id", "doc_tokens").distinct().collect())
    assert got == sorted(stages["packing"].select("doc_id", "doc_tokens").distinct().collect())
    assert set(columns) <= set(stages["packing"].columns)


def test_odd_documents_pass_all_stages(spark, odd_documents):
    names = ("hash", "digest", "fp", "component", "rows", "d", "h", "row", "n_words", "kept", "n_lines", "n_dropped", "lost", "c0", "none")
    docs = odd_documents.selectExpr(
        "doc_id", "'en' AS lang", "text", "cast(length(text) AS long) AS n_chars", *[f"concat('{c}', doc_id) AS {c}" for c in names]
    )
    columns = docs.dtypes
    given = {r.doc_id: r for r in docs.collect()}
    for _, stage in cp.STAGES[:-1]:
        docs = saved(stage(spark, docs, SF), "odd")
        assert docs.dtypes == columns
        for r in docs.collect():
            assert all(r[c] == given[r.doc_id][c] for c in ("lang", *names)) and r.n_chars == len(r.text)
    assert docs.count() == docs.distinct().count() > 0
    assert cp.packing(spark, docs, SF).count() > 0


def test_rows_without_id_are_documents(spark):
    texts = [f"{a} " + " ".join(f"{a}{i}" for i in range(60)) for a in "xyz"]
    rows = [(None, t) for t in (*texts, texts[0])] + [(7, texts[1]), (7, texts[2]), (7, texts[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in cp.near_dedup(spark, docs, SF).collect())
    assert got == [(0, texts[0]), (7, texts[1]), (7, texts[2])]


def test_no_documents(spark, no_documents):
    docs = no_documents.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    for _, stage in cp.STAGES:
        docs = saved(stage(spark, docs, SF), "none")
    assert docs.count() == 0


def test_pipeline_against_brute_force(spark, stages):
    docs = [(r.doc_id, r.text) for r in stages["documents"].collect()]
    assert len(docs) > 100
    compress = zstandard.ZstdCompressor(level=3).compress
    docs = [(d, t) for d, t in docs if cb.measure((t or "").encode(), compress)[6]]
    lines = {int(d): kept for d, kept, _, _ in brute_lines(docs)}
    docs = [(d, lines[d]) for d, _ in docs if lines[d].strip()]

    prints = [plain_fingerprint(t) for _, t in docs]
    n = range(len(docs))
    near = [(i, j) for i in n for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    root = roots_of(len(docs), near)
    first = {}
    for i, (d, _) in enumerate(docs):
        first[root[i]] = min(d, first.get(root[i], d))
    docs = [(d, t) for i, (d, t) in enumerate(docs) if first[root[i]] == d]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {int(d) for d, _, _, _, bad in brute(docs, items) if bad}
    want = {d: t for d, t in docs if d not in dirty}
    assert near and {r.doc_id: r.text for r in stages["decontamination"].collect()} == want


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_finished_tables_leave_the_shared_folder(spark, tmp_path, monkeypatch, scheme):
    monkeypatch.setattr(workspace, "shared_folder", lambda _: f"{scheme}{tmp_path}/app")
    kept, gone = saved(spark.range(3), "kept"), saved(spark.range(5), "gone")
    workspace.forget(gone)
    other = str(tmp_path / "app-other")
    spark.range(2).write.parquet(other)
    workspace.forget(spark.read.parquet(other))
    assert [p.name.split("-")[0] for p in tmp_path.glob("app/*")] == ["kept"]
    assert kept.count() == 3 and spark.read.parquet(other).count() == 2
