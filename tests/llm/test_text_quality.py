import random

import numpy as np
import pytest

from orrery.llm import text_quality as Q

EN = "the of and to in a is that it was for on are as with be this have from or by not but what all were when we there can an your which their said if do will".split()
COMMON = {"en": frozenset(EN), "de": frozenset("der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei".split())}
SENTENCE = "It was clear that the owner of the table had not read what was written in the log by then."


SENTENCES = (
    "The {0} was in the {1} when it was found by the owner of that house.", "It is not clear why the {0} can be so slow, but most of the cost is in the {1}.", "We have not said what the {0} will do if there is no {1} by the end of the day.",
    "They asked which of the two was the older {0}, and the answer was that it did not matter to the {1}.", "For now you can leave the {0} as it is, or have it moved to the {1} with all the others.", "There are few things that are as quiet as a {0} which has been left by its {1} for a week.")
NOUNS = "cat dog ledger river garden kitchen parser bridge window summer paper engine village harbour market teacher".split()


def prose(r, n=6):
    s = [r.choice(SENTENCES).format(r.choice(NOUNS), r.choice(NOUNS)) for _ in range(n)]
    return r.choice([" ".join(s), "\n".join(s), "> " + "\n> ".join(s), "— " + "\n\n— ".join(s), " ".join(s).lower()])


CASES = {
    "list": ["- red apple\n- green pear\n- old plum\n- ripe fig\n", "1. first thing\n2. second thing\n3. third thing\n", "a) one\nb) two\nc) three\n", "[ ] x y\n[x] z w\n[ ] v u\n", "alpha beta\ngamma delta\nepsilon zeta\neta theta\n", "name: red\nsize: 12 cm\nowner: smith\ncolor: none\n",
             "* " + "\n* ".join([SENTENCE] * 5), "red fig · old plum · ripe pear · new apple · dry date", "red fig; old plum; ripe pear; new apple; dry date;", SENTENCE + "\n\n" + "\n".join(f"- item number {k}" for k in range(20))],
    "table": ["| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n", "a;b;c\n1;2;3\n4;5;6\n", "a,b,c,d\n1,2,3,4\n5,6,7,8\n", "a\tb\n1\t2\n3\t4\n", "name    size    color\nfig     12      red\nplum    3       blue\n", "+---+---+\n| a | b |\n+---+---+\n| 1 | 2 |\n+---+---+\n"],
    "junk": ["na " * 60, "00000000  18 b9 5d 90 55 dd 44 f9 46 90 65 16 93 de ba 0b\n" * 4, "A+DmiTD7HH9v9VRTqqMerU9VG2gcXAm2Lsi8uSSW4dSSOQWVdZLhHnyd2bPSaggog2W+S5rIZqlc\n" * 3, "!@<+^~\\=/*-$>@+_=&|><#$ %!*/@ !>!>!-!&/@~-%~#$^>#%<$@~ ~^-^/-#_\\$*^^!&<$_|-=*/~|/",
             "z. /x, /cvvnb/,,mzz mbnvx,x mz.xx//cb,b,x/c .n/nczxm/ zbm, cmv. xnxnb/bcz.n. ,vcv,zb x. zbmn., nm/znbzn", "slak;ksall; jklkjald;l sdjfldk;a; ajjadlja; ajalddlj s;daldfd; kfk;afjjdsk;a; jldsajas; k;k",
             "zixam quervask sarkon seabam telisk dreasten marva solal veamim teastan kleamot drendel pealet hirkan", "a.xrelD tihw gedler the aresh ot dnee no swa hrtee so ms,kmoe onw tis hda eviscre akrTe het hnet yB tgin.h the ni idd hdlhseotr hte"],
}


def shares_of(text):
    return Q.forms(text, COMMON[Q.describe(text, COMMON)[0]])


@pytest.mark.parametrize("form,text", [(f, t) for f, ts in CASES.items() for t in ts])
def test_forms(form, text):
    shares = shares_of(text)
    assert max(range(4), key=lambda k: shares[k]) == ["prose", "list", "table", "junk"].index(form), shares


@pytest.mark.parametrize("seed", range(12))
def test_prose_stays_prose(seed):
    r = random.Random(seed)
    text = prose(r, r.randrange(1, 12))
    extra = r.choice(["", "\n\n- one small thing\n- another\n", "\n\n| a | b |\n|---|---|\n| 1 | 2 |\n", "\n\n# Title\n\n"])
    shares = shares_of("Quiet river\n\n" + text + extra)
    assert shares[0] == max(shares) or len(text) < len(extra)


def test_marks_of_tokenizers_are_no_table():
    text = " ".join(f"{s} <|endoftext|>" for s in (SENTENCE, SENTENCE, SENTENCE))
    assert shares_of(text)[0] > 0


def test_statistics_by_hand():
    lang, s = Q.describe("The cat, the dog.\nIt is 42", COMMON)
    d = dict(zip(Q.STATISTICS, s, strict=True))
    assert lang == "en" and round(np.expm1(d["log_words"])) == 6
    assert d["mean_word_length"] == pytest.approx(16 / 6) and d["common_share"] == pytest.approx(4 / 6)
    assert d["marked_lines"] == 0 and d["cells_per_line"] == 0 and d["long_tokens"] == 0
    d2 = dict(zip(Q.STATISTICS, Q.describe("- a|b\tc\n- d   e\n" + "x" * 30, COMMON)[1], strict=True))
    assert d2["marked_lines"] == pytest.approx(2 / 3) and d2["cells_per_line"] == pytest.approx(3 / 3) and d2["long_tokens"] == pytest.approx(30 / 38)
    assert Q.describe("abab", COMMON)[1][-1] == pytest.approx(1.0) and Q.describe("...", COMMON)[1][-1] == 0
    assert d["punctuated_lines"] == 0.5 and d["digit_ratio"] == pytest.approx(2 / 20) and d["symbol_ratio"] == pytest.approx(2 / 20)


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, path string, distance int"


def corpus():
    r = random.Random(1)
    rows = [(k, prose(r, r.randrange(2, 15)), r.choice(["en", "en", None, "xx"]), "s", 1, f"p{k}.MD", 0) for k in range(150)]
    k = 1000
    want = {}
    for form, texts in CASES.items():
        for t in texts:
            rows.append((k, t, "en", "s", None, f"q{k}.txt", 0))
            want[k] = form
            k += 1
    rows += [(5000, None, "en", "s", 1, "a.md", 0), (5001, "", "en", "s", 1, "b.md", 0), (5002, " \n\t ", None, None, 1, "c.rst", 0), (5003, CASES["list"][0], "en", "s", 1, "d.java", 0), (5004, "\u00a0\u2003", "en", "s", 1, "e.txt", 0)]
    return rows, want


def word_table(spark):
    return spark.createDataFrame([(g, k, w) for g, ws in COMMON.items() for k, w in enumerate(sorted(ws))] + [(None, 1, "x"), ("en", 2, None)], "lang string, place int, word string")


def test_operator(spark):
    rows, want = corpus()
    df, words = spark.createDataFrame(rows, DOCS), word_table(spark)
    assert {r["doc_id"]: r["form"] for r in Q.not_prose(df, words).collect()} == want
    measured = Q.measure_documents(df, words)
    m = measured.collect()
    assert {r["doc_id"] for r in m} == {r[0] for r in rows} - {5000, 5001, 5002, 5003, 5004}
    for r in m:
        assert sum(r[f"c{k}"] for k in range(len(Q.STATISTICS))) == pytest.approx(r["distance"])
    assert Q.statistics(measured).where("largest_contribution is null").count() == 0
    assert Q.statistics(Q.measure_documents(df.limit(0), words)).count() == 0
    assert Q.not_prose(df.limit(0), words).count() == 0


def test_the_distance_decides(spark):
    """Only what is far from prose is looked at; the two ways to the distance agree."""
    rows, want = corpus()
    df, words = spark.createDataFrame(rows, DOCS), word_table(spark)
    described = Q.describe_documents(df, words).cache()
    model = Q.fit(described)
    far = {r["doc_id"]: r["distance"] for r in Q.measure(described, model).where(f"distance > {Q.CANDIDATE}").collect()}
    seen = {r["doc_id"]: r["distance"] for r in Q.check_candidates(df, words, model).collect()}
    assert far.keys() == seen.keys() and far == pytest.approx(seen)
    assert want.keys() <= far.keys() and len(far) < len(want) + 75
    # with a scatter that holds everything nothing is far, and nothing found
    wide = {n: (mean, inverse / 1e6) for n, (mean, inverse) in model.items()}
    assert Q.check_candidates(df, words, wide).count() == 0


def test_prose_of_few_common_words_is_no_junk():
    text = ("Kubernetes schedules pods across nodes. Operators reconcile desired state continuously. Controllers watch resources, compare snapshots, emit events. "
            "Schedulers rank candidate machines using weighted scores. Sidecars proxy traffic between services.")
    assert shares_of(text)[0] == len(text)
    assert shares_of("zixam quervask sarkon seabam telisk dreasten marva solal veamim teastan kleamot")[3] > 0


def test_estimate_is_the_plain_one_on_clean_data():
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, len(Q.STATISTICS))) * np.array(Q.FLOOR) * 2
    m = {"en": (float(len(x)), x.sum(0), x.T @ x)}
    mean, inverse = Q.estimate(m)["en"]
    assert np.allclose(mean, x.mean(0)) and np.allclose(np.linalg.inv(inverse), np.cov(x.T, bias=True) * 0.9 + 0.1 * np.diag(np.diag(np.cov(x.T, bias=True))))
