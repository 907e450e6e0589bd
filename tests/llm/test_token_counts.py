import base64
import random

import pytest
import tiktoken

from headroom.llm import token_counts as T


@pytest.fixture(scope="module")
def counter(spark):
    return T.length_counter(spark)


def test_answers_equal_sums_over_documents(documents, counter):
    count = counter()
    lengths = [count(r.text or "") for r in documents.select("text").collect()]
    histogram = T.length_histogram(documents, counter)
    rows = T.context_limits(histogram).collect()
    assert [r.n_tokens for r in sorted(rows)] == sorted(set(lengths))
    for r in rows:
        n = r.n_tokens
        assert r.n_docs == lengths.count(n)
        assert r.longer_docs == sum(x > n for x in lengths)
        assert r.tokens_upto == sum(x for x in lengths if x <= n)
        assert r.truncated_tokens == sum(min(x, n) for x in lengths)
        assert r.share_upto == sum(x <= n for x in lengths) / len(lengths)
        assert (r.total_docs, r.total_tokens) == (len(lengths), sum(lengths))
    limits = T.truncated_totals(histogram, [0, 100, 10**6]).collect()
    assert [(r.truncated_tokens, r.longer_docs) for r in limits] == [(sum(min(x, n) for x in lengths), sum(x > n for x in lengths)) for n in (0, 100, 10**6)]
    median = T.length_quantiles(histogram, [0.5]).first()
    assert median.n_tokens == sorted(lengths)[(len(lengths) - 1) // 2]


def test_lengths_over_many_blocks(spark):
    rows = [(n, 1 + n % 3) for n in range(0, 20_000, 997)]
    got = T.context_limits(spark.createDataFrame(rows, "n_tokens long, n_docs long")).collect()
    for r in got:
        assert r.truncated_tokens == sum(min(n, r.n_tokens) * c for n, c in rows)


def test_nulls_empty_and_long(make_docs, counter, clash):
    got = T.length_histogram(clash(make_docs([(1, None), (2, ""), (3, "a " * 50_000), (3, "a " * 50_000)])), counter)
    rows = {r.n_tokens: r.n_docs for r in got.collect()}
    assert rows[0] == 2 and sorted(rows.values()) == [2, 2]
    assert T.length_histogram(make_docs([]), counter).count() == 0


@pytest.mark.parametrize("char", [" ", "\t", "\n", "\u00a0", "\u3000"])
def test_long_white_space(spark, char):
    """A run of ten million is one piece; shorter runs give what the encoding gives without cutting."""
    count = T.length_counter(spark)()
    assert count(char * 10_000_000 + "x") == count(char * 9_999_999) + count(char + "x")
    rng = random.Random(1)
    for _ in range(40):
        runs = ["".join(rng.choice([char, " ", "\n"]) for _ in range(rng.choice([1, 3, 511, 512, 513, 2000]))) for _ in range(3)]
        text = rng.choice(["", "a b"]) + "".join(run + rng.choice(["word", "1", "...", "é"]) for run in runs) + rng.choice(["", runs[0]])
        assert count(text) == plain(text), repr(text)


def plain(text):
    """Tokens without cutting white space out."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in open(T.VOCABULARY, "rb").read().splitlines() if x)}
    return len(tiktoken.Encoding("plain", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text))
