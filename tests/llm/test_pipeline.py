import public_tokenizers
import tiktoken

import corpus_pipeline as cp
from attestra.llm import bpe
from tests.llm.test_ngram_join import brute


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = cp.drop_toxic(spark, docs, sf_dir)
    assert first.columns == docs.columns and 0 < first.count() <= docs.count()
    kept = cp.drop_near_copies(spark, first, sf_dir)
    want = brute([(r.doc_id, r.text) for r in first.collect()])
    assert {r.doc_id for r in kept.collect()} == {c for _, c in want.values()}
    masked = cp.mask_personal_data(spark, kept, sf_dir)
    assert masked.columns == docs.columns and masked.count() == kept.count()
    assert masked.where("n_chars <> length(text)").count() == 0
    mixed = cp.mix_sources(spark, masked, sf_dir)
    assert mixed.columns == docs.columns
    out = cp.run(spark, sf_dir).collect()
    assert len(out) == mixed.count()
    ranks = bpe.load_ranks(cp.RANK_FILE)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in mixed.collect()}
    for r in out[:80]:
        assert r.text == texts[r.doc_id] and r.ids == library.encode_ordinary(r.text) and r.n_tokens == len(r.ids)


def test_repeated_rows_leave_one(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "s", 1), (None, text, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    out = cp.drop_near_copies(spark, docs, "")
    assert sorted([r.doc_id for r in out.collect()], key=str) == [1, None]


CLASHING = ("score", "Predicted", "copy", "rate", "mix_key", "_source", "_u", "ids", "n", "cls", "component_id", "pii", "_t", "block")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def clashing(spark):
    """Nulls in every column, empty and repeated rows, ids that repeat with other texts, and columns named like operators' own."""
    texts = [None, "", "one two three four five six seven", "one two three four five six seven", "mail a@b.cd to me", "word " * 3_000, "x"]
    rows = [(i, t, None if i % 2 else "en", None if i % 3 == 0 else f"s{i % 2}", i, *[f"{c}{i}" for c in CLASHING]) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], (6, "another text of that id", *rows[6][2:]), (None, None, None, None, None, *[None] * len(CLASHING))], SCHEMA)


def labelled(spark, tmp_path):
    spark.createDataFrame([(2, 1, 0), (5, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_keep_columns_and_values(spark, tmp_path):
    docs, sf_dir = clashing(spark), labelled(spark, tmp_path)
    own = lambda df: sorted(tuple(r) for r in df.select("doc_id", *[f"`{c}`" for c in CLASHING]).distinct().fillna("~").fillna(-1).collect())
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.schema["copy"].dataType == docs.schema["copy"].dataType, name
        assert set(own(out)) <= set(own(docs)), name
    toxic = cp.drop_toxic(spark, docs, sf_dir)
    assert toxic.count() == docs.count()  # nothing toxic was learned
    kept = cp.drop_near_copies(spark, docs, sf_dir).collect()
    assert sorted([r.doc_id for r in kept], key=str) == [0, 1, 2, 4, 5, 6, None] and {r.doc_id: r.text for r in kept}[6] == "another text of that id"
    again = cp.drop_near_copies(spark, docs.orderBy("text", "doc_id").repartition(5), sf_dir).collect()
    assert sorted(map(str, kept)) == sorted(map(str, again))
    masked = {r.doc_id: (r.text, r.n_chars) for r in cp.mask_personal_data(spark, docs, sf_dir).collect()}
    assert masked[4] == ("mail [EMAIL] to me", 18) and masked[0] == (None, None) and masked[1] == ("", 0)
    mixed = cp.mix_sources(spark, docs, sf_dir).collect()
    assert {r.source for r in mixed} <= {None, "s0", "s1"}
    tokens = {r.doc_id: r for r in cp.tokenize(spark, docs, sf_dir).collect()}
    assert tokens[0].text == tokens[1].text == "" and tokens[0].n_tokens == 0 and tokens[5].text == "word " * 3_000


def test_stages_of_an_empty_table(spark, tmp_path):
    docs, sf_dir = clashing(spark).limit(0), labelled(spark, tmp_path)
    for name, stage in cp.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0, name
