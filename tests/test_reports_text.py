"""Predicates of reports and recovery against their behaviour, stated with regular expressions in plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from glossaria.functions import validate as val
from glossaria.operators import recovery

WORDS = ["flex", "grid", "the", "Save", "p-4", "text-lg", "sm:flex", "hover:bg-red", "max-w-xl", "z-10", "rounded-xl", "user_name", "userName", "Hello", "World!", "{name}", "{{ x }}", "{{ a ? b : c }}", "a.b", "api.example.com:993", "(SSL)", "x=1", "?a=b&c=d", "ns:key", "[a]", "const", "{", "}", ";", "'k':", "gtag(", "example", "C:\\x", "/var/log", "x", "https://a.b", "www.a.b", "me@example.org", "abcd1234", "Jane", "Doe", "acme", "imap", "CRM", "crm", "strng", "12", "main", "street", "city", "state", "amazon", "s3", "class=\"x\"", "@click", "=", "height:", "12px", "serif(x)", "||", ".length", "items.length", "#fff", "-3.5", "1.2.3", "key:", "@/x", "a-b", "on-click-", "über", "…", "value", "File.TSX", "intent:x", "${a}", "and", "to"]


def samples(n=700):
    rng = random.Random(11)
    out = ["", " ", "a", "Jane Doe", "123e4567-e89b-42d3-a456-426614174000", "api.example.com:993 (SSL)", "imap.gmail.com", "a?b=c", "height: {h}px;", "serif (x)", "font-family: x", "/a/b/", "?x=1", "a=1&b=2", "{a:b;}", "{a:;}", "@click = 'x'", "amazon s3 bucket", "12 main street city state"]
    for _ in range(n):
        out.append(rng.choice(["", " "]).join(rng.choice(WORDS) for _ in range(rng.randrange(1, 5))))
    return sorted(set(out))


def css(t):
    t = t.strip(" ")
    if not t:
        return False
    tokens = [w for w in re.split(r"\s+", t) if w]
    rules = [r"(?i)^[a-z]+-[a-z0-9-]+(\s+[a-z]+-[a-z0-9-]+)*$", r"\b(flex|grid|block|inline|hidden|absolute|relative|fixed)\b", r"\b(w|h|p|m|px|py|mx|my|pt|pb|pl|pr|mt|mb|ml|mr)-", r"\b(text-|bg-|border-|rounded|shadow|overflow|cursor|opacity)", r"\b(sm|md|lg|xl|2xl|hover|focus|active|dark):", r"\b(justify|items|self|gap|space|font|leading|tracking)-", r"\b(z-\d|top-|bottom-|left-|right-)", r"^[a-z][a-z0-9]*(-[a-z0-9]+)+(\s|$)"]
    half = [w for w in tokens if re.search(r"(?i)^[a-z][a-z0-9]*(-[a-z0-9]+)+$", w) or re.match(r"(sm|md|lg|xl|2xl|hover|focus|dark):", w)]
    return any(re.search(r, t, re.A) for r in rules) or (len(tokens) >= 2 and 2 * len(half) >= len(tokens))


def code(t):
    t = t.strip(" ")
    rules = [r"(?i)^[a-z_][a-z0-9_]*$", r"^(https?:|mailto:|tel:|//|www\.)", r"^[./\\]", r"(?i)\.(ts|tsx|js|jsx|vue|json|css|scss|html|php)$", r"^\$\{.*\}$", r"^\{\{.*\}\}$", "^(intent:|scheme=|#Intent)", "^[a-z]+-[a-z-]+$", "^#[0-9a-fA-F]{3,8}$", r"^-?\d+(\.\d+)?$", r"^[a-zA-Z_$][a-zA-Z0-9_$]*:$", "^(@/|~/)"]
    return any(re.search(r, t, re.A) for r in rules)


def unreported(text):
    t = re.sub(r"\s+", " ", text).strip(" ")
    low, one = t.lower(), bool(t) and not re.search(r"\s", t)
    bare = [w for w in t.split() if not re.match(r"^\{[^}]+\}$", w)]
    classy = [w for w in bare if re.search("[-:]", w) and re.match(r"^[A-Za-z0-9:._\-\[\]]+$", w)]
    kept = re.sub("[^A-Za-z0-9]", "", t)
    word = re.match("^[A-Za-z]{3,8}$", t)
    return any([
        one and "." in t and re.match("^[A-Za-z0-9.-]+$", t), re.match("(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$", t), one and re.search("[?&]", t) and "=" in t, one and re.search(r"[:\[\]]", t) and re.match(r"^[A-Za-z0-9:._\-\[\]]+$", t),
        re.search("[{};]", t) and re.search(r"\b(const|let|var|function|return|if|else|for|while|class|async|await)\b", t), re.match(r"^[A-Za-z0-9.-]+\.[A-Za-z]{2,}(:\d+)?(\s*\([A-Za-z0-9\s]+\))?$", t),
        re.search(r"\{\{\s*[^}]+\s*\}\}", t) and re.search(r"[?:]|\|\||&&|\.length\b", t), bare and ((len(classy) >= 2 and len(classy) >= len(bare) - 1) or (len(bare) == len(classy) == 1 and "-" in bare[0])),
        "gtag(" in t or (re.search("[{}]", t) and re.search(r"""['"][^'"]+['"]\s*:""", t)), re.search(r"(?i)\bexample\b", t), re.match(r"^[\\/]\S+$", t) or re.match(r"^[A-Za-z]:[\\/]\S*$", t), len(t) == 1, re.match(r"(?i)^(https?://|www\.)", t),
        re.match(r"^[^\s@]+@[^\s@]+\.[^\s@]+$", t) and ("example." in low or "acme." in low), one and re.search("[A-Za-z]", t) and re.search(r"\d", t) and 6 <= len(t) <= 64, low in val.SAMPLE_NAMES + val.PROTOCOLS or re.search(r"\bacme\b|\bamazon s3\b", low),
        kept and len(kept) <= 4 and kept.upper() == kept, re.search(r"\d{2,}", t) and "main street" in low and "city" in low and "state" in low,
        word and ((not re.search("[aeiouy]", low) and len(t) >= 2) or (len(t) <= 6 and re.search("[bcdfghjklmnpqrstvwxyz]{3,}", low))),
    ])


def invalid(text):
    t = text.strip(" ")
    one = bool(t) and not re.search(r"\s", t)
    return any([
        re.search(r"\{[^}]*:[^;}]+;[^}]*\}", t), re.search(r"""(class|style)=["']""", t), re.search(r"@\w+\s*=", t, re.A), re.match(r"^(height|width|margin|padding|font(-family)?|color|background|border)[^;{]*;?$", t),
        re.match(r"(?i)^(sans|serif|mono|monospace|system)\s*\([^)]+\)$", t), re.search(r"\{\{\s*[^}]+\s*\}\}", t) and re.search(r"[?:]|\|\||&&|\.length\b", t), re.match("(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$", t),
        one and re.search(r"[:\[\]]", t) and re.match(r"^[A-Za-z0-9:._\-\[\]]+$", t) and re.sub(r"[\[\]]", "", t), re.search("[{};]", t) and re.search(r"\b(const|let|var|function|return|if|else|for|while|class|async|await)\b", t),
        "gtag(" in t or (re.search("[{}]", t) and re.search(r"""['"][^'"]+['"]\s*:""", t)), re.match(r"(?i)^(https?://|www\.)", t), re.match("^/[A-Za-z0-9_/-]+/?$", t), re.match(r"^[A-Za-z]:[\\/]\S*$", t),
        one and (re.match(r"^[?#][A-Za-z0-9_.-]+=", t) or re.match(r"^[A-Za-z0-9_.-]+=[^&\s]*(&[A-Za-z0-9_.-]+=[^&\s]*)+$", t)), len(t) == 1,
    ])


@pytest.mark.parametrize(("ours", "theirs", "spared"), [
    (recovery.css_classes, css, None), (recovery.code_like, code, None), (val.not_reported, unreported, val.only_placeholders), (val.value_invalid, invalid, lambda t: val.only_placeholders(t) | val.css_with_placeholders(t)),
])
def test_rules_on_words(spark, ours, theirs, spared):
    """spared: texts that another predicate, tested elsewhere, decides."""
    df = spark.createDataFrame([(t,) for t in samples()], "t string")
    rows = df.select("t", F.coalesce(ours(F.col("t")), F.lit(False)).alias("x"), (spared(F.col("t")) if spared else F.lit(False)).alias("s")).collect()
    wrong = [(r.t, r.x) for r in rows if not r.s and r.x != bool(theirs(r.t))]
    assert not wrong, wrong[:10]
    assert 0.02 < sum(r.x for r in rows) / len(rows) < 0.98


def test_template_texts(spark):
    cases = {"Hi ${user.name}, ${user.name}": "Hi {name}, {name2}", "${x}": None, "${ a + b1 } of ${7}": "{b1} of {value2}", "plain  text\n here": "plain text here", "${value} is ${value2}": "{value1} is {value2}", "é ${a}": None, "": None, "a${x}${x}${x2}": "a{x}{x2}{x22}"}
    got = {r.t: r.x for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", recovery.template_text(F.col("t")).alias("x")).collect()}
    assert got == cases


def test_harvest_places(spark):
    text = "\n".join(['<h1 title="First title here">Between tags</h1>', "{{ 'In a mustache' }}", "x = `Dear ${user.name}`; y = `${a}`", "const z = \"Quoted text one\";", "toast('Saved the file')", "<b className=\"wide\" label='Skipped line text'>", "style={{ description: 'Style line prop' }}", "dark: 'No', alert(  'No') + x: 'Ok'", "w = 'It\\'s a quote'"])
    files = spark.createDataFrame([("f", text), ("g", None), ("h", "")], "file string, text string")
    got = {(r.file, r.text): r.score for r in recovery.harvest(files).collect()}
    score = lambda t: (2 if t[0].isupper() else 0) + (2 if t[-1] in ".!?" else 0) + (1 if " " in t else 0) + (2 if 5 <= len(t) <= 100 else 0)
    want = {"Between tags": 2, "First title here": 5, "In a mustache": 4, "Dear {name}": 4, "Quoted text one": 0, "Saved the file": 0, "Skipped line text": 5, "Style line prop": 4, "It's a quote": 0}
    assert {t: s - score(t) for (f, t), s in got.items() if t in want} == want and {f for f, _ in got} == {"f"}
