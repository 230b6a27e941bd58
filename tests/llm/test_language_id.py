from __future__ import annotations

import zlib

from lodegraph.llm import language_id


def test_held_out_accuracy(spark, sf_dir):
    from lodegraph.llm.queries import op6_language_id

    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir.rsplit('/', 1)[0]}/sf0.01/documents.parquet").collect()}
    rows = op6_language_id(spark, f"{sf_dir.rsplit('/', 1)[0]}/sf0.01").collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out]
    assert sum(held) >= 0.95 * len(held)


def test_edges(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    net = language_id.train(docs, rows=60)
    rows = [(1, None, 1), (2, "", 1), (3, "12 34 !?", 1), (4, "é", 1), (None, "the house " * 20_000, 1), (5, "the", 1), (5, "the", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    found = {r.doc_id: r for r in language_id.predict(df, net).collect()}
    assert {d for d, r in found.items() if r.lang_pred == "und"} == {1, 2, 3} and found[1].score == 0
    assert found[4].lang_pred in net.languages and 0 < found[None].score <= 1
    assert language_id.predict(df.limit(0), net).collect() == []
    assert {r.lang_pred for r in language_id.identify(df.withColumnRenamed("score", "lang").selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def test_windows_cover_the_whole_text():
    data = bytes(range(1, 256)) * 5
    w = language_id.windows(data, 100)
    assert w.reshape(-1)[: len(data)].tolist() == list(data) and (w.reshape(-1)[len(data) :] == language_id.PAD).all()


def test_a_rare_language_is_learnt_however_many_rows_others_have(spark):
    rows = [(i, f"the house number {i} by the river", "en") for i in range(3000)] + [(5000 + i, f"das alte Haus Nummer {i} am Fluss", "de") for i in range(10)]
    rows += [(9000, "the same hot row", "en")] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for seed in range(3):
        assert language_id.train(df, rows=30, seed=seed).languages == ["de", "en"]


def test_texts_without_letters_are_unknown(spark):
    net = language_id.ByteConvNet.fresh(["de", "en"])
    df = spark.createDataFrame([(1, "\u00bd\u00b2\u2460 12_3"), (2, "\u00e9"), (3, "\u6f22")], "doc_id long, text string")
    assert [r.lang_pred == language_id.UNKNOWN for r in language_id.predict(df, net).orderBy("doc_id").collect()] == [True, False, False]


def test_forward_pass_and_gradient():
    """Against a plain convolution written out, and against finite differences."""
    import numpy as np

    net, rng = language_id.ByteConvNet.fresh(["a", "b", "c"], 3), np.random.default_rng(0)
    x = rng.integers(0, 257, (4, 20)).astype(np.int16)

    def plain(net):
        out = []
        for row in x:
            pooled = []
            for k, width in enumerate(language_id.WIDTHS):
                for f in range(language_id.FILTERS):
                    column = net.filters[:, k * language_id.FILTERS + f].reshape(-1, language_id.EMBEDDING)
                    last = len(row) - max(language_id.WIDTHS) + 1
                    best = max(sum(float(net.embedding[row[i + j]] @ column[j]) for j in range(width)) for i in range(last))
                    pooled.append(max(0.0, best + float(net.bias[k * language_id.FILTERS + f])))
            z = np.asarray(pooled) @ net.out + net.out_bias
            e = np.exp(z - z.max())
            out.append(e / e.sum())
        return np.asarray(out)

    assert np.allclose(net.probabilities(x), plain(net), atol=1e-4)
    y = np.asarray([0, 1, 2, 1])
    before = -np.log(net.probabilities(x)[np.arange(4), y]).mean()
    net.train(x, y, epochs=30, batch=4)
    assert -np.log(net.probabilities(x)[np.arange(4), y]).mean() < 0.2 * before
