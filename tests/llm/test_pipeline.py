import numpy as np
import public_tokenizers

import corpus_pipeline
from granary.llm import decontamination, mixing, similarity, toxicity
from granary.llm.common import table


def test_stages_agree_with_a_plain_version(spark, sf):
    from tokenizers import Tokenizer

    found = corpus_pipeline.run(spark, sf).toPandas().sort_values("start")
    docs = table(spark, sf, "documents")
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    rows = docs.toPandas().sort_values("doc_id")
    rows = rows[model.scores(list(rows.text)) < 0.5]
    from test_llm import plain_components

    group = plain_components(list(zip(rows.doc_id, rows.text, strict=True)), 5, 80)
    rows = rows[[group[i][1] == i for i in rows.doc_id]]
    dirty = decontamination.report(spark.createDataFrame(rows), table(spark, sf, "benchmark")).where("contaminated").toPandas().doc_id
    rows = rows[~rows.doc_id.isin(dirty)]
    copies = mixing.mix(spark.createDataFrame(rows)).toPandas().set_index("doc_id").copies
    rows = rows.loc[np.repeat(rows.index, copies[rows.doc_id])]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert found.doc_id.tolist() == rows.doc_id.tolist()
    assert found.n_tokens.tolist() == [len(t.encode(x, add_special_tokens=False).ids) + 1 for x in rows.text]
    assert found.start.tolist() == [0, *np.cumsum(found.n_tokens)[:-1]]


def test_stages_keep_columns_on_odd_tables(spark, sf):
    shape = table(spark, sf, "documents").schema
    made = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "word", "en", "a", 4)], shape)
    for docs in (made, made.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == shape.names
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "decontamination", "mixing", "token_files"]
    assert similarity.one_of_each.__defaults__ == (5, 80)
