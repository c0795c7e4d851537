"""Author-year grammar and reconciliation against literal cases and plain loops."""

import collections
import random

import pytest
from marginalia.functions import similarity as S
from marginalia.operators import author_year as A

#: Four entries of a real list; 114 more are generated.
ENTRIES = [
    "Aguilera, R. V., Aragón-Correa, J. A., Marano, V., & Tashman, P. A. 2021. The corporate governance of environmental sustainability: A review and proposal for more integrated research. Journal of Management, 47(6): 1468–1497.",
    "Amankwaa, E. F. 2013. Livelihoods in risk: Exploring health and environmental implications of e-waste recycling as a livelihood strategy in Ghana. Journal of Modern African Studies, 51(4): 551–575.",
    "Atasu, A., Van Wassenhove, L. N., & Sarvary, M. 2009. Efficient take-back legislation. Production and Operations Management, 18(3): 243–258.",
    "Bansal, P., & Roth, K. 2000. Why firms become eco-friendly: Ecological responsiveness and organization theory. Academy of Management Journal, 43(4): 717–736.",
] + [f"Researcher{chr(97 + i // 26)}{chr(97 + i % 26)}, J. A., & Colleague, P. {2000 + i % 25}. Synthetic parser fixture {i}. Test Journal, 12(4): 123–130." for i in range(114)]


def wrapped(entry, width=60):
    lines, now = [], ""
    for w in entry.split(" "):
        if len(now) + len(w) > width:
            lines.append(now)
            now = w
        else:
            now = f"{now} {w}".strip()
    return "\n".join([*lines, now])


LAYOUTS = {"paragraphs": "\n\n".join(ENTRIES), "breaks": "\n".join(ENTRIES), "flattened": " ".join(ENTRIES), "wrapped": "\n".join(wrapped(e) for e in ENTRIES)}


@pytest.mark.parametrize("layout", sorted(LAYOUTS))
def test_118_entries_and_one_missing_citation(spark, layout):
    refs = A.reference_entries(spark.createDataFrame([(1, LAYOUTS[layout])], "doc_id int, text string"))
    got = [r["reference"] for r in refs.orderBy("ref_idx").collect()]
    assert got == ENTRIES
    body = "".join(f" Some words ({e.split(',')[0]} et al., {A._YEAR.search(e)[1]})." for e in ENTRIES)
    cites = A.parsed_citations(A.extract(spark.createDataFrame([(1, body + " And again (Missingauthor, 1999).")], "doc_id int, text string")))
    edges = A.reconcile(cites, A.parsed_references(refs))
    rows = edges.collect()
    assert len(rows) == 119 and [r["citation"] for r in rows if r["flag"] == "missing"] == ["Missingauthor, 1999"]
    assert {r["ref_idx"] for r in rows if r["flag"] != "missing"} == set(range(118))


def test_never_the_start_of_a_reference():
    for line in ("3749. doi:10.1002/jmv.27789", "2021. Journal, 12:22–33.", "Results from the survey in 2021.", "Journal of Management, 2021, 47:12–24."):
        assert A.entries(ENTRIES[0] + "\n" + line + "\n" + ENTRIES[1]) == [ENTRIES[0] + " " + line, ENTRIES[1]]


@pytest.mark.parametrize(
    "text, want",
    [
        ("OECD, 2019, 2020", ["OECD, 2019", "OECD, 2020"]),
        ("Aiko & Logan 2014, Besley & Persson, 2014", ["Aiko & Logan, 2014", "Besley & Persson, 2014"]),
        ("Meanwhile, Claessens and Djankov, 1999", ["Claessens and Djankov, 1999"]),
        ("see Hair et al.2020", ["Hair et al., 2020"]),
        ("Lastly, Baiden, 2020", ["Baiden, 2020"]),
    ],
)
def test_chunks(text, want):
    assert A.split_chunk(text) == want


@pytest.mark.parametrize(
    "left, names",
    [("Adam", ["adam"]), ("Adam, Frimpong & Boadu", ["adam", "frimpong", "boadu"]), ("Adam et al.", ["adam"]), ("Adam, A. M., Frimpong, S., & Boadu, M. O.", ["adam", "frimpong", "boadu"]), ("Brüggen and Proença", ["bruggen", "proenca"])],
)
def test_surnames(left, names):
    assert A.surnames(left) == names


def test_citations_of_a_text():
    text = "As Smith (2020) and Brown et al. (2019a; 2021) say (see Adam & Boadu, 2017; OECD, 2018), and Smith (2020) again. Likely (2020) not. In (2003)."
    assert A.citations_of(text) == ["Smith, 2020", "Brown et al., 2019a", "Brown et al., 2021", "Adam & Boadu, 2017", "OECD, 2018"]


def test_organisations():
    assert A.acronyms("United Nations Conference on Trade and Development") == ["unctd"] and A.acronyms("Adam, A. M.") == []
    assert A.acronyms("Organisation for Economic Co-operation and Development (OECD)")[0] == "oecd" and A.first_key("World Health Organization (WHO)") == "who"
    assert A.first_key("Ghana Statistical Service") == "service" and A.first_key("Survey data") == ""


def brute(cites, refs):
    """citation -> (reference, flag) of one document."""
    parsed = [(i, r, A.parse_reference(r)) for i, r in enumerate(refs)]
    parsed = [(i, r, p) for i, r, p in parsed if p]
    out = {}
    for c in cites:
        p = A.parse_citation(c)
        if not p:
            continue
        group = [i for i, _, r in parsed if r["key"] == p["key"] and p["year"][:4] in (r["year"], r["year"][:4])]
        if p["bare"] and len(group) > 1:
            out[c] = (group[0], f"ambiguous_same_author_year:{p['key']}|{p['year'][:4]};candidates={len(group)}")
            continue
        for k in p["keys"]:
            prefer, own = [i for i, _, r in parsed if k in r["preferred"]], [i for i, _, r in parsed if k in r["plain"] or k in r["preferred"]]
            if own:
                out[c] = (prefer[-1] if prefer else own[0], f"alias:{k}")
                break
        else:
            best = (0, None)
            for i, _, r in parsed:
                if r["year"][:4] == p["year"][:4]:
                    a, b = " ".join(p["names"]), " ".join(r["names"])
                    score = max(round(100 * len(set(p["names"]) & set(r["names"])) / max(len(p["names"]), 1)), round(0.6 * S.token_set(a, b) + 0.4 * S.partial(a, b)) if a and b else 0)
                    if score > best[0]:
                        best = (score, i)
            out[c] = (best[1], f"fuzzy:{best[0]}") if best[0] >= 74 else (None, "missing")
    return out


def test_reconciliation_against_a_plain_loop(spark):
    r = random.Random(6)
    people = ["Adam", "Adams", "Boadu", "Brüggen", "Frimpong", "O'Neil", "Proença", "Smith", "Smyth"]
    refs, cites = [], []
    for doc in range(6):
        for i in range(14):
            names = r.sample(people, r.randint(1, 3))
            authors = ", ".join(f"{n}, {r.choice('ABC')}." for n in names)
            refs.append((doc, i, f"{authors} ({2000 + r.randrange(4)}{r.choice(['', '', 'a', 'b'])}). Some title of a work. Journal, 3(1), 1-9."))
        for _ in range(30):
            names, y = r.sample(people, r.randint(1, 2)), f"{2000 + r.randrange(5)}{r.choice(['', '', 'a'])}"
            cites.append((doc, r.choice([f"{names[0]}, {y}", f"{' & '.join(names)}, {y}", f"{names[0]} et al., {y}", f"{names[0][:-1]}, {y}", f"However, {names[0]}, A. {y}"])))
    distinct = [(d, i, c) for i, (d, c) in enumerate(dict.fromkeys(cites))]
    parsed = A.parsed_citations(spark.createDataFrame(distinct, "doc_id int, cite_idx int, citation string"))
    own = A.parsed_references(spark.createDataFrame(refs, "doc_id int, ref_idx int, reference string"))
    edges = A.reconcile(parsed, own).cache()
    got = {(x["doc_id"], x["citation"]): (x["ref_idx"], x["flag"]) for x in edges.collect()}
    want = {}
    for doc in range(6):
        found = brute([c for d, _, c in distinct if d == doc], [t for d, _, t in refs if d == doc])
        want |= {(doc, c): v for c, v in found.items()}
    assert got == want and {f.split(":")[0] for _, f in got.values()} == {"alias", "ambiguous_same_author_year", "fuzzy", "missing"}
    counts = {(x["doc_id"], x["ref_idx"]): x["times_cited"] for x in A.reference_counts(edges, parsed, own).collect()}
    plain = collections.Counter((d, i) for (d, _), (i, f) in got.items() if i is not None and not f.startswith("amb"))
    assert all(counts[k] >= n for k, n in plain.items()) and sum(counts.values()) >= sum(plain.values())
    total = {x["doc_id"]: x for x in A.summary(edges, A.reference_counts(edges, parsed, own)).collect()}
    assert all(total[d]["citations"] == total[d]["matched"] + total[d]["missing"] and total[d]["references"] == 14 for d in range(6))


def test_possible_matches(spark):
    refs = A.parsed_references(spark.createDataFrame([(1, 0, "Boateng, R. (2015). Some title of a work. Journal, 3."), (1, 1, "Mensah, K. (2019). Another title of a work. Journal, 3."), (1, 2, "World Bank (WB). (2018). A report on many things. Press.")], "doc_id int, ref_idx int, reference string"))
    cites = A.parsed_citations(spark.createDataFrame([(1, 0, "Boatengs, 2015"), (1, 1, "Mensah, 2017"), (1, 2, "Mensah, 2010"), (1, 3, "WBA, 2018"), (1, 4, "Zulu, 2015")], "doc_id int, cite_idx int, citation string"))
    got = {r["cite_idx"]: (r["ref_idx"], r["score"], r["kind"]) for r in A.possible_matches(cites, refs).collect()}
    assert got == {0: (0, 88.0, "name_variation"), 1: (1, 92.0, "year_variation")}


def test_words_that_are_no_authors():
    no = ["", "However", "Field survey", "survey Ghana", "The study", "likely similarly", "First results", "more so", "Ghana census", "Table"]
    yes = ["Oxford University", "Boadu", "World Bank", "National Census Bureau of Ghana", "Kofi Mensah"]
    assert [A.no_author(x) for x in no] == [True] * len(no) and [A.no_author(x) for x in yes] == [False] * len(yes)
    assert [A.without_leads(x) for x in ("Firstly, Ama", "For instance Ama", "Instance: Ama", "Subsequently, see also Ama", "Ama")] == ["Ama"] * 5
