
from curatio.operators import tokens


def _vocab(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return tokens.build_vocab(df, ["text"], 100)


def test_vocab_ranks_by_count_then_word(spark):
    v = {r.word: (r.id, r.cnt) for r in _vocab(spark, ["b a a", "c b a"]).collect()}
    assert v == {"a": (3, 3), "b": (4, 2), "c": (5, 1)}


def test_encode_truncates_and_appends_eos(spark):
    vocab = _vocab(spark, ["w1 w2 w3 w4 w5"])
    df = spark.createDataFrame([(0, "w1 w2 w3 w4 w5"), (1, ""), (2, "w1 zz</s>w2")], "k long, t string")
    got = {r.k: list(r.ids) for r in tokens.encode(df, ["k"], {"t": "ids"}, vocab, 4,
                                                   masks={"ids": "mask"}).collect()}
    ids = {r.word: r.id for r in vocab.collect()}
    assert got[0] == [ids["w1"], ids["w2"], ids["w3"], 1]
    assert got[1] == [1]
    assert got[2] == [ids["w1"], 2, 1, 1]  # unknown word, the glued end-of-sequence token, cut, then eos
    m = {r.k: list(r.mask) for r in tokens.encode(df, ["k"], {"t": "ids"}, vocab, 4,
                                                  masks={"ids": "mask"}).collect()}
    assert m[0] == [1, 1, 1, 1]


def test_prefix_counts_toward_length(spark):
    vocab = _vocab(spark, ["predict: a b c"])
    df = spark.createDataFrame([(0, "a b c")], "k long, t string")
    r = tokens.encode(df, ["k"], {"t": "ids"}, vocab, 3, prefixes={"ids": "predict:"}).collect()[0]
    ids = {x.word: x.id for x in vocab.collect()}
    assert list(r.ids) == [ids["predict:"], ids["a"], 1]


def test_decode_roundtrip(spark):
    texts = ["the cat  sat\non the mat", "a b"]
    vocab = _vocab(spark, texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, t string")
    enc = tokens.encode(df, ["k"], {"t": "ids"}, vocab, 64)
    got = {r.k: r.out for r in tokens.decode(enc, ["k"], "ids", vocab, "out").collect()}
    assert got == {0: "the cat sat on the mat", 1: "a b"}


def test_masks(spark):
    df = spark.createDataFrame([([5, -100, 1], [5, -100, -7])], "p array<int>, l array<int>")
    r = df.select(tokens.mask_predictions("p").alias("p"), tokens.mask_labels("l").alias("l")).collect()[0]
    assert list(r.p) == [5, 0, 1] and list(r.l) == [5, 0, -7]


def test_collate_pads_per_batch(spark):
    df = spark.createDataFrame([(0, "pred", [5, 6], [1, 1], [7]), (0, "pred", [5, 6, 7, 8], [1, 1, 1, 1], [7, 8, 9]),
                                (1, "pred", [9], [1], [3])],
                               "batch long, task string, input_ids array<int>, attention_mask array<int>, "
                               "labels array<int>")
    rows = tokens.collate(df, ["batch", "task"]).collect()
    b0 = [r for r in rows if r.batch == 0]
    assert {len(r.input_ids) for r in b0} == {4} and {len(r.labels) for r in b0} == {3}
    short = [r for r in b0 if r.input_ids[0] == 5 and r.input_ids[2] == 0][0]
    assert list(short.input_ids) == [5, 6, 0, 0] and list(short.attention_mask) == [1, 1, 0, 0]
    assert list(short.labels) == [7, -100, -100]
    assert [list(r.input_ids) for r in rows if r.batch == 1] == [[9]]


def test_unpivot_and_loss(spark):
    df = spark.createDataFrame([(0, [1], [1], [2, 2], [2, 2], [3], [4])],
                               "k long, input_ids array<int>, attention_mask array<int>, expl_input_ids array<int>, "
                               "expl_attention_mask array<int>, labels array<int>, aux_labels array<int>")
    u = {r.task: list(r.labels) for r in tokens.task_unpivot(df, ["k"]).collect()}
    assert u == {"pred": [3], "expl": [4]}
    losses = spark.createDataFrame([(0, 1.0, 3.0), (0, 2.0, None)], "step long, pred_loss double, expl_loss double")
    with_r = tokens.blend_losses(losses, 0.5, True).collect()[0].loss
    without = tokens.blend_losses(losses, 0.5, False).collect()[0].loss
    assert with_r == (0.5 * 1 + 0.5 * 3 + 2.0) / 2 and without == 1.5


def test_every_word_has_an_id_and_prefixes_their_own(spark):
    texts = [f"w{i} predict" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    vocab = tokens.build_vocab(df, ["t"], reserved=tokens.TASK_PREFIXES)
    assert vocab.count() == 303
    enc = tokens.encode_many(df, ["k"], [("t", "a", 64, "predict:"), ("t", "b", 64, "explain:")], vocab).collect()
    assert all(2 not in r.a and r.a[0] == 3 and r.b[0] == 4 and r.a != r.b for r in enc)


def test_rare_words_are_found_beyond_the_broadcast_head(spark, monkeypatch):
    monkeypatch.setattr(tokens, "HEAD_WORDS", 2)
    texts = ["a a a b b c d e", "c a zz"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    vocab = tokens.build_vocab(df.where("k = 0"), ["t"])
    enc = tokens.encode(df, ["k"], {"t": "ids"}, vocab, 64)
    assert {r.k: list(r.ids) for r in enc.collect()} == {0: [3, 3, 3, 4, 4, 5, 6, 7, 1], 1: [5, 3, 2, 1]}
    out = tokens.decode(enc, ["k"], "ids", vocab, "out").collect()
    assert {r.k: r.out for r in out} == {0: "a a a b b c d e", 1: "c a"}


def test_tokens_stay_in_their_rows(spark):
    df = spark.createDataFrame([(i, f"a b{i % 7} c") for i in range(50)], "k long, t string")
    vocab = tokens.build_vocab(df, ["t"])
    enc = tokens.encode(df, ["k"], {"t": "ids"}, vocab, 64)
    plan = tokens.decode(enc, ["k"], "ids", vocab, "out")._jdf.queryExecution().executedPlan().toString()
    main = "\n".join(x for x in plan.splitlines() if not x.lstrip().startswith(":"))
    assert "Generate" not in main and "Join" not in main
    assert main.count("Exchange") == 1          # of whole rows
    assert " AS _t0#" not in plan               # no row holds the table of words


def test_rows_of_one_key_share_their_tokens_and_a_null_key_has_none(spark):
    df = spark.createDataFrame([(0, "a b"), (0, "c"), (1, "b"), (None, "a")], "k long, t string")
    vocab = tokens.build_vocab(df, ["t"])
    ids = {r.word: r.id for r in vocab.collect()}
    enc = tokens.encode(df, ["k"], {"t": "ids"}, vocab, 64)
    got = sorted(((r.k, list(r.ids)) for r in enc.collect()), key=str)
    both = sorted([ids["a"], ids["c"]]) + [ids["b"], 1]
    assert got == [(0, both), (0, both), (1, [ids["b"], 1]), (None, [1])]
