"""Queries that SQL can't state, over whole tables against plain Python."""

import re

import pytest
from pyspark.sql import functions as F
from test_reports_text import code, css, unreported

from glossaria.functions import validate as val
from glossaria.operators import recovery
from glossaria.plans import registry

Q = registry.queries()


@pytest.fixture(scope="module")
def pages(spark, sf):
    return {r.page_id: r.html or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}


def test_texts_outside_comments(spark, sf, pages):
    want = []
    for k, t in pages.items():
        ranges = [m.span() for m in re.finditer(r"<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", t, re.S | re.I)]
        want += [(str(k), m.start(), m[1]) for m in re.finditer('"([^"<>]{3,})"', t) if not any(a <= m.start() < b for a, b in ranges)]
    assert sorted(tuple(r) for r in Q["comment_range_anti"](spark, sf).collect()) == sorted(want) and want


def test_unreported_examples(spark, sf, pages):
    links = {(k, x) for k, t in pages.items() for x in re.findall(r'\shref="([^"]*)"', t)}
    spared = {r.x for r in spark.createDataFrame([(x,) for _, x in links], "x string").where(val.only_placeholders(F.col("x"))).collect()}
    got = {tuple(r) for r in Q["unreported_examples"](spark, sf).collect()}
    assert got == {(k, x) for k, x in links if x in spared or unreported(x)} and got


def user_text(t):
    signs = re.search(r"^[A-Z]|[.!?:]$|\{[a-zA-Z_]\w*\}", t, re.A) or set(re.findall(r"\w+", t.lower(), re.A)) & set(recovery.COMMON)
    return len(t) >= 2 and re.search("[a-zA-Z]", t) and not css(t) and not code(t) and (re.search(r"\S\s+\S", t, re.A) or bool(signs))


def places(text):
    """(rank, bonus, text) of each place in a file, one pattern a place."""
    literal = r"""([A-Za-z][\w-]*\s*[=:(]\s*)?(?:"((?:\\.|[^"\\\n])*)"|'((?:\\.|[^'\\\n])*)')"""
    out = [(0, 2, x) for x in re.findall(">([^<>{]+)<", text)]
    parts = lambda s: [((m[1] or "").strip()[:-1].strip().lower(), (m[1] or " ").strip()[-1:], m[2] if m[2] is not None else m[3]) for m in re.finditer(literal, s, re.A)]
    for name, sign, body in parts(text):
        plain = body and not re.search("[\"']", body)
        if sign == "=" and plain and any(name == a.lower() or name.endswith("-" + a.lower()) for a in recovery.ATTRIBUTES):
            out.append((1, 5, body))
        if sign == ":" and plain and any(name.endswith(a) for a in map(str.lower, recovery.PROPERTIES)):
            out.append((5, 4, body))
        if sign == "(" and plain and any(name.endswith(a) for a in map(str.lower, recovery.CALLS)):
            out.append((6, 6, body))
    out += [(2, 4, x) for x in re.findall(r"""\{\{\s*['"]([^'"{}]+)['"]\s*\}\}""", text)]
    for line in text.split("\n"):
        if not re.search(recovery.STYLE_LINE, line):
            out += [(4, 0, b.replace('\\"', '"').replace("\\'", "'").replace("\\n", " ")) for _, _, b in parts(line) if len(b) >= 3]
    return out


@pytest.mark.parametrize("name", ["harvested_texts", "best_harvested_text"])
def test_harvest_of_pages(spark, sf, pages, name):
    assert not any("`" in t for t in pages.values())  # templates have a test of their own
    want = {}
    words = ["the"] if name == "harvested_texts" else []
    for k, t in pages.items():
        first = {}
        for rank, bonus, x in places(t):
            x = x.strip(" ")
            if x not in first or (rank, -bonus) < first[x]:
                first[x] = (rank, -bonus)
        for x, (_, b) in first.items():
            if user_text(x):
                score = sum(10 for w in words if w in x.lower()) + (2 if re.match("[A-Z]", x) else 0) + (2 if re.search(r"[.!?]\Z", x) else 0) + (1 if " " in x else 0) + (2 if 5 <= len(x) <= 100 else 0) - b
                want[f"/pages/{k}.html", x] = score
    got = {(r.file, r.text): r.score for r in Q[name](spark, sf).collect()}
    if name == "best_harvested_text":
        best = {}
        for (f, x), s in want.items():
            best[f] = max(best.get(f, (0, 0, "")), (s, len(x), x))
        want = {(f, x): s for f, (s, _, x) in best.items() if s >= 3}
    assert got == want and len(want) >= 50


def test_rewritten_pages(spark, sf, pages):
    """Known texts of tags become calls, other tags stay."""
    got = {r.file: r.text for r in Q["wrap_known_texts"](spark, sf).collect()}
    known = {x.strip() for t in pages.values() for tag, x in re.findall(r"<([a-zA-Z][a-zA-Z0-9]*)(?:\s[^<>]*)?>([^<>]+)</", t) if tag.lower() in ("li", "a")} - {""}
    assert set(got) == {str(k) for k in pages}
    between = lambda t: [x.strip() for x in re.findall(r">([^<>{}]+)<", t)]
    for k, t in pages.items():
        before, after = [x for x in between(t) if x in known], [x for x in between(got[str(k)]) if x in known]
        assert not after and got[str(k)].count("__(") - t.count("__(") == len(before)


def test_scanner_on_pages(spark, sf, pages):
    """The scanner's texts are those between tags of the page without comments, scripts and styles."""
    got = {}
    for r in Q["template_texts"](spark, sf).collect():
        got.setdefault(r.path, set()).add(r.text)
    assert set(got) <= {f"/pages/{k}.html" for k in pages}
    for k, t in pages.items():
        body = re.sub(r"(?is)<!--.*?-->|<(script|style|code|pre)\b.*?</\1>", "\n", t)
        whole = re.sub(r"\s+", " ", re.sub("<[^>]+>", " ", body))
        found = [x for x in got.get(f"/pages/{k}.html", ()) if len(x) > 20]
        assert sum(x in whole for x in found) >= 0.9 * len(found)
