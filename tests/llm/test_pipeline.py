
import corpus_pipeline
from weftwork.llm import langid, pii

from .cases import CLASHING, SCHEMA, WORD, documents, frame, with_clashes
from .test_dedup import brute_cut
from .test_near import brute_kept
from .test_tokens import expected_pieces


def write(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_stages_one_after_another(spark, tmp_path):
    rows = [*documents(60), (500, "reach me at jo@mail.example.org please", "en", "s", 38)]
    folder = write(spark, rows, tmp_path / "in")
    docs, columns, seen = spark.read.parquet(f"{folder}/documents.parquet"), None, {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs.collect())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    before, after = seen["language_id"]
    assert {r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or "")} - {r["doc_id"] for r in after} <= {67, 66}
    assert all(any(c.isalpha() for c in r["text"] or "") for r in after)
    before, after = seen["simhash_near_dedup"]
    assert sorted(str((r["doc_id"], r["text"])) for r in after) == brute_kept([tuple(r) for r in before])
    before, after = seen["substring_dedup"]
    cut = brute_cut([tuple(r) for r in before])
    left = {str((r["doc_id"], " ".join(WORD.findall(r["text"] or "")))) for r in after}
    for entry in cut:
        doc, n, gone, kept = eval(entry)  # noqa: S307
        assert (str((doc, kept)) in left) == (gone == 0 or gone < n)
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = seen["pii"]
    assert len(before) == len(after) and not any(pii.base_spans(r["text"] or "") for r in after)
    before, after = seen["best_fit_packing"]
    assert sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in after) == expected_pieces([tuple(r) for r in before], 2048)


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    docs = with_clashes(frame(spark, documents(20)))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == docs.columns and after.count() > 0
        assert after.where(" OR ".join(f"`{c}` <> 'clash' OR `{c}` IS NULL" for c in CLASHING)).count() == 0
        docs = after


def test_language_stage_by_the_model_itself(spark):
    docs = frame(spark, documents(60))
    model = langid.train(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    kept = sorted(str((r["doc_id"], r["text"])) for r in corpus_pipeline.language_id(spark, docs, "").collect())
    answers = [(r, model.predict(r["text"])) for r in docs.collect()]
    assert kept == sorted(str((r["doc_id"], r["text"])) for r, (lang, p) in answers if lang != "und" and p >= corpus_pipeline.LEAST_CERTAINTY)


def test_run_on_nothing(spark, tmp_path):
    folder = write(spark, [], tmp_path / "in")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
