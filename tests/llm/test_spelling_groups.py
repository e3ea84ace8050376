import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from duecheck.llm import queries, spelling_groups

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def neighbours(words):
    """Near words of each, by what is left when one character is taken out."""
    by_rest = defaultdict(set)
    for w in words:
        for r in {w} | {w[:i] + "\0" + w[i + 1 :] for i in range(len(w))}:
            by_rest[r].add(w)
    out = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            out[w] |= by_rest[w[:i] + "\0" + w[i + 1 :]] - {w}
            if w[:i] + w[i + 1 :] in out:
                out[w].add(w[:i] + w[i + 1 :])
                out[w[:i] + w[i + 1 :]].add(w)
    return out


def counted(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def by_hand(n):
    close = neighbours(n)
    form = {}
    for w in n:
        best = min(close[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None))
    return out


def rows(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_neighbours():
    rng = np.random.default_rng(1)
    words = sorted({"".join(rng.choice(list("ab"), rng.integers(4, 8))) for _ in range(60)})
    assert neighbours(words) == {w: {v for v in words if near(w, v)} for w in words}


@pytest.mark.parametrize("letters, low, high", [("ab", 2, 12), ("abcÀÿz", 3, 9), ("aé", 7, 40)])
def test_search_against_brute_force(letters, low, high):
    rng = np.random.default_rng(len(letters))
    words = sorted({"".join(rng.choice(list(letters), rng.integers(low, high))) for _ in range(700)} | {"a" * k for k in range(7, 90, 3)} | {"a" * 300, "a" * 301})
    asked = [w for w in words for _ in "12"] + ["ab" * 4 + "b"]
    first = np.array([k % 2 == 0 for k in range(len(asked) - 1)] + [True])
    q, w = spelling_groups.near_words(words, asked, first)
    got = Counter((asked[i], words[j]) for i, j in zip(q, w))
    assert max(got.values()) == 1  # each pair once over both searches
    close = neighbours(words)
    wanted = {(a, b) for a in words for b in close[a]}
    assert {p for p in got if p[0] in close} == wanted


@pytest.mark.parametrize("bucket_chars", [1 << 20, 1500, 60])
def test_buckets_lose_nothing(spark, bucket_chars):
    """Also where halves are hot, so that words and queries are cut into blocks."""
    rng = np.random.default_rng(3)
    words = {"preface" + "".join(rng.choice(list("abc"), 7)) for _ in range(150)} | {"".join(rng.choice(list("xyz"), 7)) + "suffixes" for _ in range(100)}
    words |= {"".join(rng.choice(list("ab"), rng.integers(7, 11))) for _ in range(150)}
    n = {w: int(rng.choice([2, 3, 25, 400, 9000])) for w in sorted(words)}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    forms = spelling_groups.near_forms(df, bucket_chars)
    assert {(r.word, r.form, r.n, r.n_near, r.form_n) for r in forms.collect()} == {(w, f, c, k, m) for w, f, _, c, k, m in by_hand(n)}


def test_query_against_hand_count(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = rows(queries.queries()["op13_spelling_groups"](spark, SMALL))
    wanted = by_hand(counted(docs))
    assert got == wanted and len(got) > 1000 and any(r[1] for r in got)


def test_long_chain_of_forms(spark):
    chain = ["aaaaaaab"[:7] + "b" * k for k in range(12)]
    forms = spark.createDataFrame(list(zip(chain, chain[1:])), "word string, form string")
    assert {(r.word, r.root) for r in spelling_groups.roots(forms).collect()} == {(w, chain[-1]) for w in chain[:-1]}


def test_odd_rows(spark):
    docs = [
        (1, "Colours colours COLOURS coloúrs colour's ÀÉÎÕÜßÿ àéîõüßÿ ÀÉÎÕÜßÿ"), (1, "colours"), (None, "colours colouxs"), (None, "colouxs"),
        (2, None), (3, ""), (4, "x" * 2_000), (5, "x" * 2_000), (6, "y1y2 colours_colours"), (7, "colours " * 90_000),
    ]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    got = rows(spelling_groups.group_variants(df))
    assert got == by_hand(counted(docs)) and len(got) >= 3
    assert spelling_groups.group_variants(df.limit(0)).collect() == []
    assert spelling_groups.group_variants(df.where("doc_id = 3")).collect() == []


def test_very_long_word():
    words = ["x" * 20_000, "x" * 20_001, "y" * 7]
    q, w = spelling_groups.near_words(words, words * 2, np.array([True] * 3 + [False] * 3))
    assert sorted((int(i) % 3, int(j)) for i, j in zip(q, w)) == [(0, 1), (1, 0)]
