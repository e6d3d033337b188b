import html
import random

import pytest

from tesserae.sources import markup


def page(rng):
    """A page and the paragraphs in it, made side by side."""
    words = ["law", "of", "é", "a&b", "x<y", "contract", "42"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))

    def shown(t):
        parts = [html.escape(x) for x in t.split(" ")]
        if rng.random() < 0.3:
            parts[0] = f"<b>{parts[0]}</b>"
        return rng.choice([" ", "\n ", "  "]).join(parts)

    def items():
        kind = rng.choice(["ul", "ol", "table"])
        own = [text() for _ in range(rng.randrange(1, 4))]
        if kind == "table":
            return "<table>" + "".join(f"<tr><td>{shown(x)}</td></tr>" for x in own) + "</table>", own
        return f"<{kind}>" + "".join(f"<li>{shown(x)}</li>" for x in own) + f"</{kind}>", own

    out, want = [], []
    for _ in range(rng.randrange(6)):
        p = text()
        own = f"<p class='c'>{shown(p)}</p>" if rng.random() < 0.8 else f"<p>{shown(p)}"
        closed = own.endswith("</p>")
        after = []
        if closed and rng.random() < 0.4:
            for _ in range(rng.randrange(1, 3)):
                markup_, found = items()
                own += rng.choice(["", "\n"]) + markup_
                after += found
        out.append(own)
        if closed and rng.random() < 0.3:
            out.append("<script>var t = '<p>no</p>';</script><h2>title</h2>" + items()[0])
        want += [f"{p} {x}" for x in after] or [p]
        if not closed:  # an open paragraph ends with the next one, or with the division
            out[-1] = f"<div>{out[-1]}</div>"
    return "<!DOCTYPE html><html><body>" + "".join(out) + "</body></html>", list(dict.fromkeys(want))


@pytest.mark.parametrize("seed", range(3))
def test_paragraphs_against_the_making(spark, seed):
    rng = random.Random(seed)
    pages = [(i, *page(rng)) for i in range(80)]
    df = spark.createDataFrame([(i, m, "clash") for i, m, _ in pages] + [(900, None, ""), (901, "", ""), (902, "no markup", "")], "page_id long, html string, text string").repartition(4)
    got: dict = {}
    for r in markup.html_paragraphs(df).orderBy("page_id", "pos").collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    assert got == {i: want for i, _, want in pages if want}
