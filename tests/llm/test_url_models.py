"""The URL filter's language model against counts in Python."""

import random

from kvlake.llm import url_filter


def grams(text):
    marked = "\x02\x02\x02" + text + "\x03"
    return [[marked[i + 1 - k : i + 1] for k in (4, 3, 2, 1)] for i in range(3, len(marked))]


def test_every_gram_has_its_own_ratio(spark):
    r = random.Random(5)
    chars = "abcdefghijklmnopqrstuvwxyz0123456789"
    texts = [("".join(r.choice(chars) for _ in range(60)), i % 2 == 0) for i in range(3000)]
    model = url_filter.language_models(spark.createDataFrame(texts, "text string, accepted boolean")).localCheckpoint()
    want = {g for t, _ in texts for place in grams(t) for g in place}
    assert len(want) > 1 << 17
    assert model.count() == len(want)
    ratios = {x["gram"]: x["ratio"] for x in model.collect()}
    assert set(ratios) == want
    urls = [t for t, _ in texts[:20]] + ["".join(r.choice(chars + "é/") for _ in range(n)) for n in range(40)]
    df = spark.createDataFrame(list(enumerate(urls)), "id int, text string")
    for bound in (0, url_filter.BROADCAST_ROWS):
        for x in url_filter.score(df, model, "text", ["id"], bound).collect():
            own = [next((ratios[g] for g in place if g in ratios), 0.0) for place in grams(urls[x["id"]])]
            assert abs(x["score"] - sum(own) / len(own)) < 1e-9
