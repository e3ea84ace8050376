import re
from itertools import permutations

from duecheck.llm import filter_audit

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(rows):
    """(part, failed filters, label) of each row, found one by one."""
    out = []
    for i, text, lang, label in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _, _ in rows),
        }
        out.append((lang or "", {k for k, v in bad.items() if v}, label))
    return out


def by_hand(rows):
    out = {}
    docs = fails(rows)
    for part in {p for p, _, _ in docs}:
        own = [(f, label) for p, f, label in docs if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(own)
            for step, name in enumerate(order, 1):
                removed = [d for d in left if name in d[0]]
                left = [d for d in left if name not in d[0]]
                failing = [d for d in own if name in d[0]]
                total[name] += len(removed)
                out[part, "".join(order), step] = [
                    len(left), len(removed), len(failing) - len(removed), sum(f == {name} for f, _ in own),
                    sum(label[0] == 1 for _, label in removed), sum(label[1] == 1 for _, label in removed),
                ]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(total[order[step - 1]])
    return out


LONG = " ".join(f"w{i}" for i in range(250))
ROWS = [
    (1, LONG, "en", (1, 0)), (2, LONG, "en", (0, 1)), (2, LONG, "en", (0, 1)), (3, LONG + " #", "de", (1, 1)), (4, "A B", None, (1, None)),
    (5, None, "", (None, None)), (6, "", "en", (None, 1)), (7, "word " * 300, "en", (0, 0)), (8, "word " * 300, "de", (1, 0)),
    (None, LONG, "de", (None, None)), (None, LONG, "en", (None, None)), (9, LONG.upper(), "en", (0, 0)), (10, "ÀÉ" + LONG + " A\x0bB\x0c", "fr", (1, 0)),
    (11, "\t\n ", "fr", (None, None)), (12, LONG * 400, "fr", (1, 0)), (1, LONG, "en", (1, 0)), (0, "A B", "en", (None, None)),
]


def tables(spark, rows):
    docs = spark.createDataFrame([(i, t, p, 5) for i, t, p, _ in rows], "doc_id long, text string, lang string, good int")
    labels = spark.createDataFrame(
        [(i, *label, "x") for i, _, _, label in rows] + [(99, 1, 1, "x"), (None, 1, 1, "x")], "doc_id long, quality int, toxic int, lang string"
    )
    return docs, labels


def test_against_hand_count(spark):
    got = filter_audit.audit(*tables(spark, ROWS)).collect()
    assert {(r.part, r.filter_order, r.step): [r[c] for c in COUNTS] for r in got} == by_hand(ROWS)
    assert len(got) == 4 * 600


def test_many_copies(spark):
    rows = [(i, LONG if i % 3 else f"{i} " + LONG, "en", (i % 2, 0)) for i in range(300)]
    got = filter_audit.audit(*tables(spark, rows)).collect()
    assert {(r.part, r.filter_order, r.step): [r[c] for c in COUNTS] for r in got} == by_hand(rows)


def test_own_part_and_empty(spark):
    from pyspark.sql import functions as F

    docs, labels = tables(spark, ROWS)
    one = filter_audit.audit(docs, labels, F.lit(None)).collect()
    assert len(one) == 600 and {r.part for r in one} == {""}
    assert len({r.kept for r in one if r.step == 5}) == 1
    assert filter_audit.audit(docs.limit(0), labels).collect() == []
    assert len(filter_audit.audit(docs, labels.limit(0)).collect()) == 2400
