"""Notes, sections and blocks: the parser's own examples, and state machines in plain loops over random pages."""

import random
import re

from plansift.operators import notes as op

SCHEMA = "doc_id string, place int, text string, top double, edge double"


def frame(spark, pages, edge=0.14, gap=0.02):
    rows = [(p, k, t if isinstance(t, str) else t[0], round(0.05 + gap * k, 9) if isinstance(t, str) else t[1], edge if isinstance(edge, float) else edge(k)) for p, lines in pages.items() for k, t in enumerate(lines)]
    return spark.createDataFrame(rows, SCHEMA)


def test_sections_examples(spark):
    pages = {
        "none": ["Random body text", "More body text"],
        "parts": ["PART 1 - GENERAL", "Scope of work applies to...", "Related sections: 03 30 00.", "PART 2 - PRODUCTS", "Manufacturers approved.", "PART 3 - EXECUTION", "Install per manufacturer."],
        "numbers": ["SECTION 03 30 00", "CAST-IN-PLACE CONCRETE", "SECTION 09 29 00.13", "Interior gypsum board shaft wall."],
        "notes": ["GENERAL NOTES", "1. All work shall conform to...", "2. Coordinate with structural."], "construction": ["GENERAL CONSTRUCTION NOTES", "Body content."],
        "preamble": ["Project preamble text here.", "PART 1 - GENERAL", "Body."], "subs": ["1.01 before any", "PART 1 - GENERAL", "1.01 SUMMARY", "text", "1.02 SCOPE"],
    }
    got = {}
    for r in sorted(op.spec_sections(frame(spark, pages)).collect(), key=lambda r: r["section"]):
        got.setdefault(r["doc_id"], []).append((r["header"], r["body"]))
    assert "none" not in got
    assert got["parts"] == [("PART 1 - GENERAL", "Scope of work applies to... Related sections: 03 30 00."), ("PART 2 - PRODUCTS", "Manufacturers approved."), ("PART 3 - EXECUTION", "Install per manufacturer.")]
    assert [h for h, _ in got["numbers"]] == ["SECTION 03 30 00", "SECTION 09 29 00.13"] and len(got["notes"]) == 1 and got["construction"][0][0] == "GENERAL CONSTRUCTION NOTES"
    assert got["preamble"] == [("", "Project preamble text here."), ("PART 1 - GENERAL", "Body.")]
    assert [h for h, _ in got["subs"]] == ["", "PART 1 - GENERAL", "1.01 SUMMARY", "1.02 SCOPE"]
    assert [r["header"] for r in op.spec_sections(frame(spark, {"s": pages["subs"]}), False).collect() if r["section"]] == ["PART 1 - GENERAL"]


def test_forms_in_their_order(spark):
    pages = {
        "numbered": ["lead", "1. one", "goes on", "(2) two", "3) three"], "tagged": ["K-01 first", "more", "K-02 second", "K-03. third"], "mixed tags": ["K-01 first", "D-02 second", "X-99 third", "Q-7 fourth"],
        "lettered": ["A. alpha", "B. beta", "more beta", "D. delta", "E. epsilon"], "chaotic": ["A. alpha", "Q. q", "B. b", "Z. z"], "sections": ["NOTES", "body", "LEGEND", "more"], "plain": ["nothing", "here"],
    }
    got = {}
    for r in sorted(op.parsed(frame(spark, pages)).collect(), key=lambda r: r["nth"]):
        got.setdefault(r["doc_id"], [r["form"]]).append((r["key"], r["note"]))
    assert got["numbered"] == ["numbered", ("1", "one goes on"), ("2", "two"), ("3", "three")]
    assert got["tagged"] == ["tagged", ("K-01", "first more"), ("K-02", "second"), ("K-03", "third")]
    assert got["lettered"][0] == "lettered" and got["lettered"][2] == ("B", "beta more beta") and got["sections"] == ["sections", ("NOTES", "body"), ("LEGEND", "more")]
    assert set(got) == {"numbered", "tagged", "lettered", "sections"}
    spread = op.parsed(frame(spark, {"t": pages["tagged"]}, edge=lambda k: 0.1 + 0.2 * (k == 1))).collect()
    assert spread and spread[0]["form"] == "tagged"
    assert op.parsed(frame(spark, {"t": ["K-01 first", "K-02 second"]}, edge=lambda k: 0.1 + 0.2 * k)).collect() == []


def machine(lines):
    """One page's blocks by the states none, open, open with notes."""
    out, block, last = [], None, None
    for text, top in lines:
        near = last is not None and abs(round(top - last, 9)) < 0.01
        last = top
        number = re.match(r"^(\d+)\.\s*", text)
        if re.match(r"(?i)^(?:GENERAL\s+)?NOTES?:?\s*$", text):
            out.append(block)
            block = [text, []]
            continue
        if number and (block or number[1] == "1"):
            block = block or ["NOTES", []]
            block[1].append([text])
            continue
        if block and block[1]:
            if near and not number:
                block[1][-1].append(text)
                continue
            out.append(block)
            block = None
    return [(b[0], len(b[1]), " ".join(t for n in b[1] for t in n)) for b in [*out, block] if b and len(b[1]) >= 2]


def test_note_blocks_equal_a_state_machine(spark):
    rng = random.Random(8)
    kinds = ["NOTES", "GENERAL NOTES:", "1. first", "2. second", "3. third", "12. later", "plain text", "more text"]
    pages = {}
    for p in range(250):
        top, lines = 0.05, []
        for _ in range(rng.randint(0, 16)):
            top = round(top + rng.choice([0.0, 0.02, 0.02]), 9)
            lines.append((rng.choice(kinds), top))
        pages[f"p{p}"] = lines
    got = {}
    for r in sorted(op.note_blocks(frame(spark, pages)).collect(), key=lambda r: r["block"]):
        got.setdefault(r["doc_id"], []).append((r["title"], r["notes"], r["text"]))
    assert got == {p: m for p, lines in pages.items() if (m := machine(lines))}
