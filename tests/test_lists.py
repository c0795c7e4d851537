"""Reference lists in every layout, and the cut between entries with bare years."""

import textwrap

import pytest
from pyspark.sql import functions as F

from marginalia.operators import extract as T
from marginalia.operators import lists as X


def letters(i):
    return chr(97 + i // 26) + chr(97 + i % 26)


OWN = [
    "Adu-Gyamfi, K. B., van der Berg, P., & Østergård, L. 2019. A long view: lessons of 2010, 1999. Rings, 12(4): 123–130. https://doi.org/10.1000/a1",
    "World Health Organization. 2021. Report on rings in 2020. Author.",
    "UNESCO. 2018a. Plates for all. Author.",
    "O'Neil, A. (2017). Was 2015 a good year? Plate Studies, 3(1), 1-9.",
]
ENTRIES = OWN + [f"Researcher{letters(i)}, J. A., & Colleague, P. {2000 + i % 25}. Synthetic parser fixture {i}. Test Journal, 12(4): 123–130." for i in range(114)]
LAYOUTS = {
    "paragraphs": "\n\n".join(ENTRIES), "breaks": "\n".join(ENTRIES), "flattened": " ".join(ENTRIES),
    "wrapped": "\n".join(line for e in ENTRIES for line in textwrap.wrap(e, 60, break_long_words=False, break_on_hyphens=False)),
}
BODY = "A text cites (Ama, 2001).\n\nResults from the survey in 2021. Ama, K. 2001 is cited.\n\n"


@pytest.mark.parametrize("layout", LAYOUTS)
def test_lists_in_four_layouts(spark, layout):
    text = f"{BODY}References\n\n{LAYOUTS[layout]}\n\nAppendix A\n\nSmith, J. 2001. Not a reference, in an appendix. Nowhere, 1: 1–2."
    got = X.reference_lists(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")).orderBy("ref_idx").collect()
    assert [r["reference"] for r in got] == ENTRIES and {r["extractor"] for r in got} == {"block"} and [r["ref_idx"] for r in got] == list(range(118))


def test_what_never_starts_an_entry(spark):
    never = ["3749. doi:10.1002/jmv.27789", "2021. Journal, 12:22–33.", "Results from the survey in 2021.", "Journal of Management, 2021, 47:12–24.", "Ama, K., & Boadu, L.", "In 2021. Ama"]
    always = [*OWN, "Ama, K. and Boadu, L. A. (n.d.). X.", "Mensah J., A."[:0] + "Mensah, J. 2020, Y."]
    got = spark.createDataFrame([(x,) for x in never + always], "t string").select(X.starts_entry(F.col("t")).alias("s"))
    assert [r["s"] for r in got.collect()] == [False] * len(never) + [True] * len(always)


def test_cuts_need_a_closed_dated_entry(spark):
    cases = {
        " ".join(OWN): OWN,
        # co-authors wrapped before their year are no entries of their own; a title's years do not open one
        "Ama, K. Boadu, L. 2001. One. Ama, K. 2002. Two": ["Ama, K. Boadu, L. 2001. One.", "Ama, K. 2002. Two"],
        "Ama, K. 2001. One, 22–33. 2021. Journal. Results from 2021. Boadu, L. 2003. Two.": ["Ama, K. 2001. One, 22–33. 2021. Journal. Results from 2021.", "Boadu, L. 2003. Two."],
        "": [],
    }
    got = spark.createDataFrame([(x,) for x in cases], "t string").select("t", X.cut_entries(F.col("t")).alias("e")).collect()
    assert {r["t"]: r["e"] for r in got} == cases


def test_torn_entries_are_mended(spark):
    rows = [(["Ama, K. 2001. One, 22–", "33.", "440. https://doi.org/10.1/x", "Boadu, L. 2002. Two."],)]
    got = spark.createDataFrame(rows, "e array<string>").select(X.repaired(F.col("e")).alias("e")).first()["e"]
    assert got == ["Ama, K. 2001. One, 22– 33 440. https://doi.org/10.1/x", "Boadu, L. 2002. Two."]


def test_other_extractors(spark):
    square = "Body.\nReferences\n" + "\n".join(f"[{i}] A. Writer, On rings and\n plates number {i}, 2001." for i in range(1, 7))
    quoted = "\n".join(f'See [{i}] Ama Writer, Kofi Reader, "A title of work number {i}" and more.' for i in range(1, 7))
    tail = "\n".join(["Line."] * 20 + ["Ama, K. A paper of some length on rings, 2001, with more text.", "and more", "Boadu, L. Another paper of length on plates, 2003, also with text.", "", "none"])
    few = "References\nAma, K. 2001. One of very few works on rings.\n"
    twice = "References\n" + "\n".join([f"Ama, K. {2001 + i}. A work on the rings of {i} trees." for i in range(6)] + ["AMA, K. 2001. A work on  the rings of 0 trees."])
    got = {}
    for r in X.reference_lists(spark.createDataFrame(list(enumerate([square, quoted, tail, few, twice])), "doc_id int, text string")).orderBy("ref_idx").collect():
        got.setdefault((r["doc_id"], r["extractor"]), []).append(r["reference"])
    assert got == {
        (0, "block"): [f"[{i}] A. Writer, On rings and plates number {i}, 2001." for i in range(1, 7)],
        (1, "pattern"): [f'[{i}] Ama Writer, Kofi Reader, "A title of work number {i}"' for i in range(1, 7)],
        (2, "tail"): ["Ama, K. A paper of some length on rings, 2001, with more text. and more", "Boadu, L. Another paper of length on plates, 2003, also with text."],
        (3, "tail"): ["Ama, K. 2001. One of very few works on rings."],
        (4, "block"): [f"Ama, K. {2001 + i}. A work on the rings of {i} trees." for i in range(6)],
    }


# --- tables and figures
def audited(spark, rows):
    blocks = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "doc_id int, block_idx int, text string, style string, is_table boolean, is_graphic boolean")
    found = sorted((r["type"], r["block_idx"], r["kind"], r["number"]) for r in T.audit_findings(blocks).collect())
    return found, T.table_audit(blocks).first().asDict()


def plain(*texts):
    return [(t, None, False, False) for t in texts]


def test_kinds_are_two_and_every_callout_counts(spark):
    found, sums = audited(spark, [*plain("As Table 1 shows, Figure 3 is discussed below.", "Table 1. Growth"), ("", None, True, False), *plain("Figure 2. A view")])
    assert found == [("missing_target", 0, "figure", "3"), ("unreferenced", 3, "figure", "2")] and (sums["tables"], sums["figures"], sums["unreferenced"], sums["missing_targets"]) == (1, 1, 1, 1)
    found, sums = audited(spark, plain("Tables 1 and 2 show it; Figures 1–3 as well.", "Table 1. A", "Table 2: B", "Figure 1 - C", "Fig. 2. D", "Figure 3. E"))
    assert found == [] and (sums["tables"], sums["figures"]) == (2, 3)
    # the number of a table under the label of a figure; a caption and a callout of two kinds are no pair
    found, _ = audited(spark, plain("See Figure 1.", "Table 1. A"))
    assert found == [("label_mismatch", 0, "figure", "1"), ("unreferenced", 1, "table", "1")]


def test_numbers_lists_and_captions(spark):
    got = spark.createDataFrame([("Tables 1, 2 and A3; fig. 2, Figs. 2–4 & 7; Table 5–3; Figure 1.2; table b; Tables 4-6/9",)], "t string").select(T.mentioned(F.col("t")).alias("m")).first()["m"]
    assert [(m["kind"][0], m["number"]) for m in got] == [*[("t", n) for n in ("1", "2", "A3")], *[("f", n) for n in ("2", "2", "3", "4", "7")], ("t", "5"), ("f", "1.2"), ("t", "B"), *[("t", n) for n in ("4", "5", "6", "9")]]
    rows = [*plain("Table 1 shows growth.", "Table 2 Growth of rings", "Table 1. One", "Table 1: Again", "Table 3. Three"), ("Table 4", "Caption", False, False), ("Growth of things", "Caption", False, False), ("", None, True, False), *plain("x", "y", "List of figures", "Figure 9. Listed", "1 Results", "Figure 1. Seen"), ("", None, True, False)]
    found, sums = audited(spark, rows)
    assert found == [
        ("duplicate_number", 2, "table", "1"), ("duplicate_number", 3, "table", "1"), ("missing_caption", 7, "table", None), ("missing_caption", 14, "table", None), ("missing_caption_number", 6, None, None), ("missing_caption_title", 5, None, None),
        ("missing_target", 1, "table", "2"), ("missing_target", 5, "table", "4"), ("numbering_sequence", None, "table", None), ("unreferenced", 4, "table", "3"), ("unreferenced", 13, "figure", "1"),
    ] and sums["numbering_or_caption"] == 7


def test_sections(spark):
    texts = ["Plain", "chapter  one", "text", "2.1 Methods", "SECTION 4", "3 " + "long " * 30, None]
    blocks = spark.createDataFrame(list(enumerate(texts)), "block_idx int, text string").withColumn("doc_id", F.lit(1))
    assert [r["section"] for r in T.section_blocks(blocks).orderBy("block_idx").collect()] == ["Document body", "chapter one", "chapter one", "2.1 Methods", "2.1 Methods", "2.1 Methods", "2.1 Methods"]
    styled = blocks.withColumn("style", F.when(F.col("block_idx").isin(2, 6), "Heading 1"))
    assert [r["section"] for r in T.section_blocks(styled).orderBy("block_idx").collect()][2:4] == ["text", "2.1 Methods"]


# --- numbered lists on pages
def chain_of(numbers):
    """All chains, the plain way: quadratic."""
    size, before = [1] * len(numbers), [-1] * len(numbers)
    for i, n in enumerate(numbers):
        for j in range(i):
            if numbers[j] == n - 1 and size[j] + 1 > size[i]:
                size[i], before[i] = size[j] + 1, j
    if not numbers:
        return []
    at, out = size.index(max(size)), []
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def test_longest_chain():
    import random

    r = random.Random(5)
    assert X.longest_chain([]) == [] and X.longest_chain([7, 1, 2019, 2, 1, 3, 12]) == [1, 3, 5] and X.longest_chain([3, 9]) == [0]
    for _ in range(300):
        numbers = [r.randint(1, 8) for _ in range(r.randint(0, 30))]
        assert X.longest_chain(numbers) == chain_of(numbers)


def test_numbered_references_on_pages(spark):
    left, right = 10.0, 320.0
    rows = [
        (1, 1, left, 1.0, "Body text [1] here"), (1, 1, left, 2.0, "[1] Ama, K. One."), (1, 1, left, 3.0, "12. 22–33."), (1, 1, right, 1.0, "[2] Boadu, L. Two"), (1, 1, right, 2.0, "2001) goes on"), (1, 2, left, 1.0, "of it."), (1, 2, left, 2.0, "3. Kock. Three."),
        (1, 2, right, 5.0, " "), (2, 1, left, 1.0, "no list"), (3, 1, left, 1.0, "4) Four"),
    ]
    boxes = spark.createDataFrame(rows, "doc_id int, page int, x0 double, y0 double, text string").withColumn("width", F.lit(600.0))
    got = {(r["doc_id"], r["number"]): r["reference"] for r in X.numbered_references(boxes).collect()}
    assert got == {(1, 1): "[1] Ama, K. One. 12. 22–33.", (1, 2): "[2] Boadu, L. Two 2001) goes on of it.", (1, 3): "3. Kock. Three.", (3, 4): "4) Four"}


def test_numbered_references_equal_a_loop(spark):
    import re
    from collections import defaultdict

    from marginalia.plans import list_queries as Q
    from marginalia.plans.registry import QUERIES, Tables

    sf = "/root/testdata/sf0.001"
    docs = defaultdict(list)
    for b in Q._boxes(Tables(spark, sf)).collect():
        docs[b["doc_id"]].append((b["page"], 0 if b["x0"] < 25 else 1, b["y0"], b["x0"], b["text"]))
    want = {}
    for doc, boxes in docs.items():
        texts = [b[-1] for b in sorted(boxes)]
        marks = [(i, int(m[1] or m[2])) for i, t in enumerate(texts) if (m := re.match(r"\s*(?:\[(\d{1,4})\]|(\d{1,4})[.)]\s)", t))]
        chosen = [marks[k] for k in chain_of([n for _, n in marks])]
        for (i, n), (j, _) in zip(chosen, [*chosen[1:], (len(texts), 0)], strict=True):
            want[doc, n] = " ".join(texts[i:j])
    assert {(r["doc_id"], r["number"]): r["reference"] for r in QUERIES["boxed_references"](spark, sf).collect()} == want and len(want) > 30
