"""Broken pairs of question and answer."""

from pagemill.llm import answers as A
from pagemill.llm.queries import QUERIES

ASKED = "Who is responsible for appointing the Registrar under Article 20 of the Harbour Rules?"
GOOD = "The Registrar is appointed by the Board of Governors for a term of 8 years and is entitled to refuse any application."
CASES = [
    (GOOD, None),
    ("The Board of Governors", None),
    (GOOD + " See the Harbour file (Article 43)", None),
    ("On the question who is responsible for appointing the Registrar under Article 20 of the Harbour Rules, the pages say this. " + GOOD, None),
    (None, "empty"), (" ​", "empty"), ("N/A", "empty"), ("...", "empty"),
    ("I must leave this one open for now.", "refusal"),
    ("Question: " + ASKED.lower(), "copy"),
    ("La demande a été rejetée parce que le contrat n'avait pas été remis à temps.", "language"),
    (GOOD[:70], "truncated"), (GOOD[:70] + "...", "truncated"), (GOOD + " Nothing in the (see", "truncated"),
]
ANSWER = "answer struct<b:boolean,n:double,s:string,arr:array<string>>"


def test_registered():
    assert "p4_found" in QUERIES


def test_defects(spark):
    refs = [("q", "free_text", ASKED, (None, None, GOOD, None), 1), ("q", "free_text", ASKED, (None, None, GOOD, None), 2), ("b", "boolean", "Is it?", (None, None, "x", None), 1), ("n", "number", "How many?", None, 1), ("m", "names", "Who are they?", (None, None, None, ["", "-"]), 1)]
    refs += [(f"o{k}", "free_text", q, (None, None, "I must leave this one open for now.", None), 1) for k, q in enumerate(["Why did the court dismiss the claim?", "What happens if the landlord fails?", "Under which rule is it due?"])]
    refs = spark.createDataFrame(refs, f"question_id string, answer_type string, question string, {ANSWER}, loaded_at int")
    results = [(i, "q", (None, None, s, None), 1) for i, (s, _) in enumerate(CASES)] * 2
    results = spark.createDataFrame(results, f"result_id bigint, question_id string, {ANSWER}, loaded_at int").selectExpr("*", "'clash' AS defect", "'clash' AS form")
    got = sorted(tuple(r) for r in A.answer_defects(refs, results).collect())
    want = [("reference", "b", "empty"), ("reference", "m", "empty"), *(("reference", f"o{k}", "refusal") for k in range(3)), *(("result", str(i), d) for i, (_, d) in enumerate(CASES) if d)]
    assert got == sorted(want)


def test_empty_tables(spark):
    refs = spark.createDataFrame([], f"question_id string, answer_type string, question string, {ANSWER}, loaded_at int")
    results = spark.createDataFrame([], f"result_id bigint, question_id string, {ANSWER}, loaded_at int")
    assert A.answer_defects(refs, results).count() == 0


def test_clusters_are_verified(spark):
    base = " ".join(f"w{i}" for i in range(30))
    near, far = base.replace("w29", "v"), base.replace("w15", "v").replace("w8", "v")
    forms = spark.createDataFrame([(base,), (near,), (far,), ("other words",)], "form string")
    got = {r.form: r.leader for r in A.form_clusters(forms).collect()}
    assert got[base] == got[near] and got[far] == far and got["other words"] == "other words"


def test_clusters_hold_all_that_similar_pairs_link(spark):
    words = [f"w{i}" for i in range(30)]
    chain = [" ".join(words[k:] + [f"v{i}" for i in range(k)]) for k in range(0, 12, 2)]  # each is similar to the next alone
    hub = [" ".join([f"h{i}" for i in range(9)] + [f"{x}{i}" for i in range(40)]) for x in "abc"]  # alike in their first shingles only
    hub += [h + " end" for h in hub]
    forms = chain + hub + ["", "w1 w2", "w1 w2 w3 w4 w5 w6"]
    got = {r.form: r.leader for r in A.form_clusters(spark.createDataFrame([(f,) for f in forms], "form string")).collect()}

    leader = {f: f for f in forms}
    for _ in forms:
        for x in forms:
            for y in forms:
                a, b = A.shingles(x), A.shingles(y)
                if len(a & b) >= A.SIMILAR * len(a | b):
                    leader[x] = min(leader[x], leader[y])
    assert got == leader and len({leader[x] for x in chain}) == 1 and len({leader[x] for x in hub}) == 3


def test_clusters_against_all_pairs(spark):
    import random

    pick = random.Random(3)
    base = [[f"w{pick.randrange(60)}" for _ in range(pick.randrange(4, 40))] for _ in range(12)]
    forms = set()
    for words in base * 12:
        own = list(words)
        for _ in range(pick.randrange(3)):
            own[pick.choice((0, -1, pick.randrange(len(own))))] = f"v{pick.randrange(9)}"
        forms.add(" ".join(own[: len(own) - pick.randrange(2)]))
    forms = sorted(forms)
    leader = {f: f for f in forms}
    near = [(x, y) for x in forms for y in forms if len(A.shingles(x) & A.shingles(y)) >= A.SIMILAR * len(A.shingles(x) | A.shingles(y))]
    for _ in range(20):
        for x, y in near:
            leader[x] = min(leader[x], leader[y])
    got = {r.form: r.leader for r in A.form_clusters(spark.createDataFrame([(f,) for f in forms], "form string")).collect()}
    assert got == leader and 12 < len(set(leader.values())) < len(forms)
