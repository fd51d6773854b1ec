import random

from pyspark.sql import functions as F

from jobweft.llm import entity_linking
from jobweft.llm.entity_linking import link_names, same_entity_pairs

SCHEMA = "id bigint, company_name string, domain string, group_id string, pid string"
ROWS = [
    (1, "Fipun Dutobu Software GmbH", "fipundutobu.co.uk.example"), (2, "Dutobu GmbH", "www.fipundutobu.co.uk.example"), (3, "Fipnu Dutobu Sotfware Holdings", "workday.jobs.example"),
    (4, "Software Fipun and Dutobu", "lever.jobs.example"), (5, "FDS, Ltd", "careers.fipun-dutobu.com.example"), (6, "FipunDutobu", "fipundutobu.io.example"), (7, "F. Dutobu SW", "jobs.fipundutobusoftware.io.example"),
    (8, "Fípun Dutobu Software", "dutobucareers.com.example"),
    (20, "Ralos Dutobu Energy", "ralosdutobu.com.example"), (21, "Dutobu", "lever.jobs.example"), (22, "Dutobu", "workday.jobs.example"),  # a family name and shared hosts alone
    (30, None, "fipundutobu.io.example"), (31, "  ", "fipundutobu.io.example"), (32, "&&", "x.example"), (None, "Fipun Dutobu Software", "fipundutobu.io.example"),
    (40, "Inc", "lever.jobs.example"), (41, "Engineering Ltd", None), (50, "Long " * 5000, None), (51, "Long " * 5000, None), (60, "Dupen Lenari Foods", None), (61, "dupen lenari foods", None), (61, "dupen lenari foods", None),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def test_groups(spark):
    got = {}
    for r in link_names(frame(spark)).collect():
        got.setdefault(r["group_id"], set()).add(r["id"])
    assert {1, 2, 3, 4, 5, 6, 7, 8} in got.values() and {60, 61} in got.values()
    assert {20} in got.values() and {21} in got.values() and {22} in got.values()
    assert not {30, 31, 32, None} & set().union(*got.values())


def test_pairs_and_empty(spark):
    pairs = {tuple(r) for r in same_entity_pairs(frame(spark)).collect()}
    assert len([p for p in pairs if p[0] <= 8]) == 28 and (60, 61) in pairs and all(a < b for a, b in pairs)
    assert same_entity_pairs(frame(spark, [])).count() == 0


def test_full_names_with_short_words(spark):
    rows = [(1, "Roy Smith Robotics", "lever.jobs.example"), (2, "Roy Smith Robotics", "workday.jobs.example"), (3, "东方 科技", None), (4, "东方 科技", "lever.jobs.example"), (5, "R. Smith Robotics", None), (6, "R. Smith Robotics", None)]
    assert {tuple(r) for r in same_entity_pairs(frame(spark, rows)).collect()} == {(1, 2), (3, 4)}


def test_sister_firms_on_one_domain(spark):
    """Each full name on a label is compared with its short names, whatever the order of the profiles' hashes."""
    for a, b in (("Alpena Betoru", "Gamidu Deltosa"), ("Gamidu Deltosa", "Alpena Betoru"), ("Kolina Vamuro", "Zerapi Tulomed"), ("Fonubi Larken", "Wistal Dorumne")):
        short = f"{b[0]}. {b.split()[1]}"
        rows = [(1, a, "northgroup.example.com"), (2, b, "northernlight.example.com"), (3, short, "northernlight.example.com"), (4, a, "northernlight.example.com")]
        pairs = {tuple(r) for r in same_entity_pairs(frame(spark, rows)).collect()}
        assert pairs == {(2, 3), (1, 4)}, (a, b)


def edited(rng, word, edits):
    for _ in range(edits):
        i = rng.randrange(len(word) or 1)
        word = rng.choice([word[:i] + word[i + 1:], word[:i] + rng.choice("abdeiklmnorstu") + word[i:], word[:i] + rng.choice("abdeiklmnorstu") + word[i + 1:], word[:i] + word[i:i + 2][::-1] + word[i + 2:]])
    return word


FAR = [
    (1, "Engelbrechtsen Wallenstadter", None), (2, "Engelprechtzen Wallemstatter", None),  # two edits in each word
    *[(10 + i, f"{w} Smith", None) for i, w in enumerate("Haverkamp Oduya Lindqvist Pereira Takahashi Novotny Campbell Iyer Brzezinski Castellanos Guðmundur Papadakis".split())], (30, "Smith Havercamb", None),  # a family name that many hold
    (40, "Tomaso Veludi Karenko", None), (41, "Veludi Tomaso Karenko", None), (42, "VTK", "veluditomasokarenko.example"),  # the other order is written together
    (50, "IBM", "ibm.example"), (51, "International Business Machines", "ibm.example"),  # a short label
    (60, "Q. One", f"{'abcdefghij' * 7}.example"), (61, "Q. Two", f"{'abcdefghij' * 6}abcdefghik.example"),  # labels longer than a host may have
    (70, "Kabor Ninul", None), (71, "Kabon Nimul", None), (72, "Vorik Tasel Udomi Gepan", None), (73, "Vorak Tazel Udimi Gepam", None),  # just at the threshold
    (80, "Abernathy Konstantinopel Energy", None), (81, "Avernady Constantinobel Energy", None), (82, "Abernathy Konstantinopel Foods", None),
]


def test_all_pairs_at_the_threshold_are_met(spark, monkeypatch):
    """Groups are those of a comparison of all pairs: nothing is left out for being misspelt in all its words, for common words, lengths or order."""
    rng = random.Random(7)
    words = ["".join(rng.choice("bdklmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    rows = list(FAR)
    for i in range(100, 320):
        name = [edited(rng, w, rng.choice([0, 0, 0, 1, 1, 2, 3])) for w in rng.sample(words[:8] if i % 5 == 0 else words, rng.choice([1, 2, 2, 2, 3, 4, 8]))]
        label = rng.choice([None, None, None, "".join(name), "".join(name[::-1]), "".join(w[0] for w in name if w)])
        rows.append((i, " ".join([*name, rng.choice(["", "", "Energy", "Foods"])]), label and f"{edited(rng, label, rng.choice([0, 0, 1, 2]))}.example"))
    groups = lambda: {r["id"]: r["group_id"] for r in link_names(frame(spark, rows)).collect()}
    got = groups()
    assert {i: got[i] for i in (2, 30, 41, 42, 51, 61, 71, 73, 81, 82)} == {2: 1, 30: 10, 41: 40, 42: 40, 51: 50, 61: 60, 71: 70, 73: 72, 81: 80, 82: 82}
    monkeypatch.setattr(entity_linking, "candidate_pairs", lambda facts, *_: facts.select(F.col("pid").alias("a")).join(facts.select(F.col("pid").alias("b")), F.col("a") < F.col("b")))
    assert got == groups()
    # with next to every word taken for a common one, the others ask for less
    monkeypatch.undo()
    met = entity_linking.candidate_pairs
    monkeypatch.setattr(entity_linking, "candidate_pairs", lambda *a: met(*a, hot=2, least_near=0.3))
    assert got == groups()
