"""Groups of similar texts against all pairs."""

import random

from kvlake.llm import simhash


def brute(texts):
    """The ids that stay: the smallest of each component over similar pairs."""
    sets = [set(simhash.shingle_set(t.encode().lower().split())) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for b in range(len(texts)):
        for a in range(b):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in range(len(texts)) if find(i) == i}


def kept(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r["doc_id"] for r in simhash.keep_one_similar(df).collect()}


def passage(r, n, words=5000):
    return [f"w{r.randrange(words)}" for _ in range(n)]


def test_copies_with_an_appended_passage_go(spark):
    r, texts = random.Random(1), []
    for n in (60, 200, 1000):
        for share in (0.12, 0.22):
            for _ in range(25):
                base = passage(r, n)
                texts += [" ".join(base), " ".join(base + passage(r, int(share * n)))]
    texts += ["a a a a a", "a a a a a a a", "b c", "b  C", "", " "]
    want = brute(texts)
    assert len(want) == 150 + 3
    assert kept(spark, texts) == want


def test_copies_among_many_texts_over_one_vocabulary_go(spark):
    """Word sets that are equal but for the passage of each copy."""
    r, texts = random.Random(2), []
    words = passage(r, 200, 10**6)
    for _ in range(40):
        r.shuffle(words)
        texts += [" ".join(words), " ".join(words + passage(r, 24))]
    want = brute(texts)
    assert len(want) == 40
    got = kept(spark, texts)
    assert (len(got), got) == (40, want)


def test_copies_among_many_orders_of_the_same_words_go(spark):
    """More than 64 equal word sets; the first is like none of the others."""
    r, texts = random.Random(3), []
    words = passage(r, 100, 10**6)
    texts.append(" ".join(words))
    for _ in range(50):
        r.shuffle(words)
        texts += [" ".join(words), " ".join(words[:-2] + words[:-3:-1])]
    want = brute(texts)
    assert len(want) == 51
    got = kept(spark, texts)
    assert (len(got), got) == (51, want)
