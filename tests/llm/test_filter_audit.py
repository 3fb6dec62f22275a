"""Filter audit against a step-by-step run of every order; the SQL holds the whole query on given and odd rows."""

from itertools import permutations

from rivermeld.llm.filter_audit import audit

GOOD = " ".join(f"word{k}" for k in range(60))
DOCS = [(1, GOOD, "a"), (2, GOOD, "b"), (2, GOOD, "b"), (3, "short", "a"), (4, "short", None), (5, None, ""), (6, "", "a"), (None, GOOD, "a"), (None, "alone", "a"),
        (7, "again and " * 40, "a"), (8, GOOD.upper(), "a"), (9, GOOD + " #", "b"), (10, "SHOUT $ " * 100, "b"), (11, "long text of many words " * 100_000, "c")]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, 1, 1), (7, None, 1), (None, 1, 1), (8, 1, None), (99, 1, 1)]


def verdicts(doc_id, text, docs):
    words = text.split()
    out = set()
    if len(words) < 50:
        out.add("A")
    if 100 * len(set(words)) < 65 * len(words):
        out.add("B")
    if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text):
        out.add("C")
    if any(c in "#$%&*|" for c in text):
        out.add("D")
    if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in docs):
        out.add("E")
    return out


def expected():
    judged = [(s or "", verdicts(i, t or "", DOCS), any(i is not None and x[0] == i and x[1] == 1 for x in LABELS),
               any(i is not None and x[0] == i and x[2] == 1 for x in LABELS)) for i, t, s in DOCS]
    rows = {}
    for part in {j[0] for j in judged}:
        mine, worth = [j for j in judged if j[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [j for j in left if f in j[1]]
                left = [j for j in left if f not in j[1]]
                worth[f] += len(gone)
                rows[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in j[1] for j in mine) - len(gone), sum(j[1] == {f} for j in mine),
                    sum(j[2] for j in gone), sum(j[3] for j in gone)]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                rows[part, "".join(order), step].append(worth[f])
    return rows


def test_every_order_step_by_step(spark):
    docs = spark.createDataFrame([(*d, "x", 0, "y") for d in DOCS], "doc_id long, text string, source string, part string, bits int, hash string")
    labels = spark.createDataFrame([(*x, 5) for x in LABELS], "doc_id long, quality int, toxic int, n int")
    got = {(r[0], r[1], r[2]): list(r[3:]) for r in audit(docs, labels).collect()}
    assert got == expected()


def test_hot_text_marks_all_but_the_smallest(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'the same text' AS text", "'s' AS source").repartition(7)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    row = audit(docs, labels).where("filter_order = 'EABCD' AND step = 1").first()
    assert (row.removed, row.kept, row.redundant) == (4999, 1, 0)
