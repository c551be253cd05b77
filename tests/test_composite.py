"""Composite regions against a loop over one page's boxes at a time."""

import random
import re

from plansift.operators import composite as op


def area(b):
    return max(b[2] - b[0], 0) * max(b[3] - b[1], 0)


def shared(a, b):
    return max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)


def near(a, b):
    both = shared(a, b)
    return both / (area(a) + area(b) - both) > 0.5 if both else False


def loop(boxes, headers, saved, classified):
    of = lambda n: [b for b in boxes if b[1] == n]
    confirmed = lambda b, n: any(area(c[3]) and round(shared(b, c[3]) / area(c[3]), 9) >= 0.6 for c in of(n))

    def header(b):
        strip = (b[0], b[1], b[2], b[1] + (b[3] - b[1]) * 0.15)
        return next((h for _, h, box in sorted(headers) if h and shared(strip, box) > 0 and any(re.search(rf"\b{k}\b", h, re.I) for k in op.HEADERS)), None)

    out = {"table": [], "title_block": [], "drawings": []}

    def put(kind, box, conf, sources, head=None):
        for r in out[kind]:
            if near(r[0], box):
                r[0] = (min(r[0][0], box[0]), min(r[0][1], box[1]), max(r[0][2], box[2]), max(r[0][3], box[3]))
                r[1], r[3] = max(r[1], conf), r[3] or head
                r[2] += [s for s in sources if s not in r[2]]
                return
        out[kind].append([box, conf, list(sources), head])

    for b in sorted(of("tables")):
        g, v, h, head = confirmed(b[3], "grid"), confirmed(b[3], "vertical_area"), confirmed(b[3], "horizontal_area"), header(b[3])
        conf = 0.95 if head else 0.85 if g else 0.8 if v or h else 0.7
        put("table", b[3], conf, ["yolo:tables"] + ["yolo:grid"] * g + ["yolo:vertical_area"] * v + ["yolo:horizontal_area"] * h + ["ocr:header_keyword"] * bool(head), head)
    for box in saved:
        put("table", box, 0.95, ["parsedRegions"])
    for box in classified:
        put("table", box, 0.6, ["pageIntel:classifiedTables"])
    for b in sorted(of("grid")):
        x, y = (b[3][0] + b[3][2]) / 2, (b[3][1] + b[3][3]) / 2
        if header(b[3]) and not any(r[0][0] <= x <= r[0][2] and r[0][1] <= y <= r[0][3] for r in out["table"]):
            put("table", b[3], 0.65, ["yolo:grid", "ocr:header_keyword"], header(b[3]))
    for b in sorted(of("title_block")):
        v = confirmed(b[3], "vertical_area")
        put("title_block", b[3], 0.95 if v else 0.85, ["yolo:title_block"] + ["yolo:vertical_area"] * v)
    for b in sorted(of("drawings")):
        put("drawings", b[3], 0.8, ["yolo:drawings"])
    for r in out["drawings"]:
        if len({b[2] for b in of("drawings") if near(b[3], r[0])}) > 1:
            r[1] = 0.95
    return {(k, r[0], r[1], "+".join(r[2]), r[3]) for k, rs in out.items() for r in rs}


def test_pages_equal_a_loop(spark):
    rng = random.Random(9)
    names = ["tables", "tables", "grid", "grid", "vertical_area", "horizontal_area", "title_block", "drawings", "drawings"]
    box = lambda w: (x := round(rng.random() * 0.5, 2), y := round(rng.random() * 0.5, 2), round(x + w + rng.choice([0, 0.05]), 2), round(y + w, 2))
    boxes, headers, saved, classified, want = [], [], [], [], set()
    for page in range(60):
        mine = [(f"d{k:02d}", rng.choice(names), rng.choice(["medium", "primitive"]), box(rng.choice([0.1, 0.3, 0.4]))) for k in range(rng.randint(1, 14))]
        heads = [(f"r{k}", rng.choice(["DOOR SCHEDULE", "Notes", "plain", None, "SCHEDULED"]), box(0.2)) for k in range(3)]
        own, old = [box(0.3)] * (page % 3 == 0), [box(0.3)] * (page % 4 == 0)
        boxes += [(page, d, n, m, *b) for d, n, m, b in mine]
        headers += [(page, r, h, *b) for r, h, b in heads]
        saved += [(page, "s", *b) for b in own]
        classified += [(page, "c", *b) for b in old]
        want |= {(page, *r) for r in loop(mine, heads, own, old)}
    edges = "minx double, miny double, maxx double, maxy double"
    df = lambda rows, schema: spark.createDataFrame(rows, f"doc_id long, {schema}, {edges}")
    got = op.page_regions(df(boxes, "det_id string, name string, model string"), df(headers, "region string, header string"), df(saved, "det_id string"), df(classified, "det_id string")).collect()
    assert {(r["doc_id"], r["kind"], (r["minx"], r["miny"], r["maxx"], r["maxy"]), r["confidence"], r["sources"], r["header"]) for r in got} == want
    assert {r["kind"] for r in got} == {"table", "title_block", "drawings"} and any("parsedRegions" in r["sources"] for r in got) and any(r["sources"] == "yolo:grid+ocr:header_keyword" for r in got)
