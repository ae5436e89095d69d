"""Scalar functions over keys, paths and texts, as Column builders of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typography that is brought to plain ASCII, as pairs of (characters, replacement)
SPACES = "\u00a0" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u202f\u205f\u3000"
TYPOGRAPHY = (("\u2018\u2019\u201a\u201b", "'"), ("\u201c\u201d\u201e\u201f", '"'), ("\u2013\u2014\u2015", "-"), (SPACES, " "))
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooo" + "\0" + "uuuuyyAAAAAACEEEEIIIINOOOOOUUUUY")
# Entities that are decoded by name
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&reg;": "®", "&hellip;": "…", "&mdash;": "—", "&ndash;": "–", "&laquo;": "«", "&raquo;": "»", "&amp;": "&"}
MARKDOWN = r"([\\`*_{}\[\]()#+\-.!|])"


def strip_bom(text: Column) -> Column:
    """Drop a leading U+FEFF; one inside stays."""
    return F.regexp_replace(text, "^\ufeff", "")


def collapse(text: Column) -> Column:
    """Whitespace runs become a space, ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def cache_key(source: Column, target: Column, text: Column) -> Column:
    return F.concat_ws("::", source, target, F.lower(collapse(text)))


def typography(text: Column) -> Column:
    """Typographic quotes, dashes and blanks as ASCII, no zero-width characters, dots for an ellipsis; ASCII texts stay as they are."""
    chars, plain = "".join(c for c, _ in TYPOGRAPHY), "".join(to * len(c) for c, to in TYPOGRAPHY)
    fixed = F.replace(F.translate(text, chars + ZERO_WIDTH, plain), F.lit("\u2026"), F.lit("..."))
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(fixed)


def decode_entities(text: Column) -> Column:
    """Named references and numeric ones, decimal or hexadecimal; a number that is no character stays. An ampersand comes last."""
    parts = F.split(text, "&#")
    code = lambda x: F.split_part(x, F.lit(";"), F.lit(1))
    hexed = lambda x: F.lower(F.left(x, F.lit(1))) == "x"
    number = lambda x: F.when(hexed(x) & F.substring(code(x), 2, 9).rlike("^[0-9a-fA-F]{1,6}$"), F.conv(F.substring(code(x), 2, 9), 16, 10).try_cast("int")).when(code(x).rlike("^[0-9]{1,7}$"), code(x).try_cast("int"))
    known = lambda x: x.contains(";") & number(x).between(1, 0x10FFFF) & ~number(x).between(0xD800, 0xDFFF)
    put = lambda x: F.concat(_character(number(x)), F.substring(x, F.char_length(code(x)) + 2, F.char_length(x)))
    rest = F.transform(F.slice(parts, 2, F.size(parts)), lambda x: F.when(known(x), put(x)).otherwise(F.concat(F.lit("&#"), x)))
    text = F.when(text.contains("&#"), F.concat(parts[0], F.array_join(rest, ""))).otherwise(text)
    for name, to in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(to))
    return text


def _character(code: Column) -> Column:
    """The character of a code point, by its UTF-8 bytes."""
    low = lambda shift: (F.call_function("shiftright", code, F.lit(shift)) % 64) + 128
    lead = lambda mark, shift: F.call_function("shiftright", code, F.lit(shift)) + mark
    two = lambda x: F.lpad(F.hex(x), 2, "0")
    hexed = F.when(code < 0x80, two(code)).when(code < 0x800, F.concat(two(lead(192, 6)), two(low(0)))).when(code < 0x10000, F.concat(two(lead(224, 12)), two(low(6)), two(low(0)))).otherwise(F.concat(two(lead(240, 18)), two(low(12)), two(low(6)), two(low(0))))
    return F.decode(F.unhex(hexed), "UTF-8")


def unaccent(text: Column) -> Column:
    """Accented Latin letters to their base letters."""
    source, to = zip(*[(a, b) for a, b in zip(*ACCENTS, strict=False) if b != "\0"], strict=True)
    return F.translate(text, "".join(source), "".join(to))


def hash36(text: Column) -> Column:
    """32-bit string hash (31 h + code, wrapped) of a text in the basic plane, absolute, base 36, at most 8 digits."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    wrapped = F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c + F.lit(2147483648), F.lit(4294967296)) - F.lit(2147483648))
    return F.substring(F.lower(F.conv(F.abs(wrapped).cast("string"), 10, 36)), 1, 8)


def slug_words(text: Column, words: int = 4) -> Column:
    """The first words of letters and digits, joined by underscores; only the text's beginning is matched."""
    plain = F.lower(unaccent(text))
    plain = F.when(F.octet_length(plain) == F.char_length(plain), plain).otherwise(F.regexp_replace(plain, r"[^\x00-\x7F]+", ""))
    begin = F.regexp_extract(plain, r"^[^a-z0-9]*+((?:[a-z0-9]++[^a-z0-9]++){0,%d}[a-z0-9]*+)" % (words - 1), 1)
    return F.rtrim(F.regexp_replace(begin, "[^a-z0-9]+", "_"), F.lit("_"))


def has_slug(text: Column) -> Column:
    """Whether slug() finds a word."""
    return unaccent(text).rlike("[A-Za-z0-9]")


def slug(text: Column, words: int = 4, length: int = 48) -> Column:
    """First words of letters and digits, joined by underscores; a text without any is named by its hash."""
    cut = F.substring(slug_words(text, words), 1, length + 1)
    found = F.when(F.char_length(cut) > length, F.rtrim(F.substring(cut, 1, length), F.lit("_"))).otherwise(cut)
    return F.coalesce(F.nullif(found, F.lit("")), F.concat(F.lit("text_"), hash36(text)))


def pascal(text: Column) -> Column:
    """Words at "_", "-", blanks and lower-to-upper steps, each with an upper first letter, joined."""
    spaced = F.regexp_replace(F.regexp_replace(text, "[_-]+", " "), "([a-z0-9])([A-Z])", "$1 $2")
    words = F.filter(F.split(spaced, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")


def namespace(path: Column) -> Column:
    """Dotted Pascal segments of a source path without extension; a last segment that names a component is left out."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\.[^./]*$", ""), "/"), lambda s: s != "")
    kept = F.when(F.element_at(parts, -1).rlike("^[A-Z][a-zA-Z0-9]*$"), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    name = F.array_join(F.filter(F.transform(kept, pascal), lambda s: s != ""), ".")
    return F.when(name == "", "Common").otherwise(name)


def root_of(path: Column) -> Column:
    """Lower-cased first segment; templates below /resources/views/ belong to views."""
    return F.when(path.contains("/resources/views/"), "views").otherwise(F.lower(F.split_part(F.ltrim(path, F.lit("/")), F.lit("/"), F.lit(1))))


def common_short(text: Column, banned: str = "/") -> Column:
    """At most two words and 24 characters, no sentence mark, none of the banned characters."""
    t = F.trim(text)
    return (t != "") & (F.size(F.split(t, r"\s+")) <= 2) & (F.length(t) <= 24) & ~t.rlike("[.!?" + banned + "]")


def key_of(ns: Column, kind: Column, text: Column) -> Column:
    return F.concat_ws(".", F.when(common_short(text), "Commons").otherwise(ns), kind, slug(text))


def placeholders(text: Column) -> Column:
    """Distinct {name} and {{ expression }} of a text."""
    double = F.transform(F.regexp_extract_all(text, F.lit(r"\{\{\s*([^{}]+?)\s*\}\}"), F.lit(1)), lambda x: F.trim(x))
    single = F.regexp_extract_all(F.regexp_replace(text, r"\{\{[^{}]*\}\}", ""), F.lit(r"\{([A-Za-z0-9_.]+)\}"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(double, single)))


def label(segment: Column) -> Column:
    """user_profile, userProfile -> User profile."""
    spaced = F.trim(F.lower(F.regexp_replace(F.regexp_replace(segment, "([a-z0-9])([A-Z])", "$1 $2"), "[_-]+", " ")))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1 << 20))


def key_variations(key: Column) -> Column:
    """The key, without its first one and two segments, its last segment, its last two."""
    parts = F.split(key, r"\.")
    n = F.size(parts)
    cut = lambda a, k: F.array_join(F.slice(parts, a, k), ".")
    return F.array_distinct(F.filter(F.array(key, F.when(n > 1, cut(2, n)), F.when(n > 2, cut(3, n)), F.element_at(parts, -1), F.when(n > 1, cut(n - 1, F.lit(2)))), lambda x: x.isNotNull()))


def hints(key: Column) -> Column:
    """Words of more than two letters in the last segment."""
    last = F.element_at(F.split(key, r"\."), -1)
    return F.filter(F.split(F.lower(F.regexp_replace(last, "([a-z0-9])([A-Z])", "$1_$2")), "[_-]+"), lambda w: F.length(w) > 2)


def relevance(text: Column, words: Column) -> Column:
    """10 a hint, 2 for a capital, 2 for a sentence mark, 1 for a blank, 2 for 5 to 100 characters."""
    hit = F.size(F.filter(words, lambda w: F.contains(F.lower(text), w))) * 10
    return hit + F.when(text.rlike("^[A-Z]"), 2).otherwise(0) + F.when(text.rlike("[.!?]$"), 2).otherwise(0) + F.when(text.contains(" "), 1).otherwise(0) + F.when(F.length(text).between(5, 100), 2).otherwise(0)


def similarity(a: Column, b: Column) -> Column:
    """Of two keys: 1 if equal, 0.1 if their depth differs by more than one, else 0.7 of the shared segments and 0.3 of one
    less the largest normalised edit distance of segments in the same place."""
    x, y = F.split(a, r"\."), F.split(b, r"\.")
    shared = F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))
    apart = F.zip_with(x, y, lambda p, q: F.levenshtein(F.coalesce(p, F.lit("")), F.coalesce(q, F.lit(""))) / F.greatest(F.length(F.coalesce(p, F.lit(""))), F.length(F.coalesce(q, F.lit(""))), F.lit(1)))
    return F.when(a == b, 1.0).when(F.abs(F.size(x) - F.size(y)) > 1, 0.1).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), shared * 0.7 + (1 - F.array_max(apart)) * 0.3)))


def fix_parens(text: Column) -> Column:
    """Drop one stray parenthesis at either end where counts differ by one."""
    t = F.trim(text)
    gap = F.regexp_count(t, F.lit(r"\(")) - F.regexp_count(t, F.lit(r"\)"))
    return F.when((gap == 1) & t.startswith("("), F.trim(F.substring(t, 2, 1 << 20))).when((gap == 1) & t.endswith("("), F.trim(F.regexp_replace(t, r"\($", ""))).when((gap == -1) & t.endswith(")"), F.trim(F.regexp_replace(t, r"\)$", ""))).when((gap == -1) & t.startswith(")"), F.trim(F.substring(t, 2, 1 << 20))).otherwise(text)


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, MARKDOWN, r"\\$1")


def escape_regex(text: Column) -> Column:
    """The text as a regular expression that matches just it."""
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def template_parts(text: Column) -> Column:
    """Struct of a template literal: statics, its constant parts; expressions, what stands in ${} between them; base, the parts joined by blanks."""
    statics = F.split(text, r"\$\{[^}]+\}")
    base = F.trim(F.regexp_replace(F.array_join(statics, " "), r"\s+", " "))
    return F.struct(statics.alias("statics"), F.transform(F.regexp_extract_all(text, F.lit(r"\$\{([^}]+)\}"), F.lit(1)), lambda x: F.trim(x)).alias("expressions"), base.alias("base"))


def strip_fence(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*```[A-Za-z]*\s*", ""), r"\s*```\s*$", ""))


def inline_default(code: Column) -> Column:
    """The default in t(k, "d"), t(k) || "d" or t(k) ?? "d"."""
    second = F.regexp_extract(code, r"""\bt\(\s*['"][^'"]+['"]\s*,\s*['"]([^'"]+)['"]""", 1)
    other = F.regexp_extract(code, r"""\bt\(\s*['"][^'"]+['"]\s*\)\s*(?:\|\||\?\?)\s*['"]([^'"]+)['"]""", 1)
    return F.coalesce(F.nullif(second, F.lit("")), F.nullif(other, F.lit("")))


def target_file(key: Column) -> Column:
    first = F.split_part(key, F.lit("."), F.lit(1))
    return F.when(first == "Commons", "common.json").otherwise(F.concat(F.lower(first), F.lit(".json")))


def lookup(messages: Column, key: Column) -> Column:
    """messages[key], or the key itself."""
    return F.coalesce(F.element_at(messages, key), key)


def version_parts(version: Column) -> Column:
    """First three numbers of a version, comparable as an array."""
    return F.transform(F.slice(F.split(F.regexp_replace(F.regexp_replace(version, "^v", ""), "[-+].*$", ""), r"\."), 1, 3), lambda x: x.try_cast("int"))


# File extensions and the language they stand for
LANGUAGES = {"ts": "typescript", "tsx": "typescriptreact", "js": "javascript", "mjs": "javascript", "jsx": "javascriptreact", "vue": "vue", "cs": "csharp", "cshtml": "razor", "razor": "razor", "py": "python", "go": "go"}


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.element_at(known, ext), ext)


def severity(level: Column) -> Column:
    return F.when(F.lower(level) == "error", 0).when(F.lower(level).isin("info", "information"), 2).when(F.lower(level) == "hint", 3).otherwise(1)


def unescape_literal(text: Column) -> Column:
    """Simple escapes of a quoted literal."""
    for a, b in ((r"\\n", "\n"), (r"\\t", "\t"), (r"\\r", "\r"), (r"\\'", "'"), (r'\\"', '"'), (r"\\\\", r"\\")):
        text = F.regexp_replace(text, a, b)
    return text


def quote_literal(text: Column) -> Column:
    """A single-quoted literal of the text."""
    return F.concat(F.lit("'"), F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n")), F.lit("'"))


def template_pattern(text: Column) -> Column:
    """${a.b} becomes {b}."""
    return F.regexp_replace(text, r"\$\{\s*(?:[A-Za-z_$][\w$]*\.)*([A-Za-z_$][\w$]*)\s*\}", r"{$1}")


def key_issues(key: Column) -> Column:
    """What is wrong with a key's shape, in order."""
    found = F.array(
        F.when(~key.rlike(r"^[A-Za-z0-9_.\-]+$"), "characters"), F.when(F.length(key) > 200, "length"),
        F.when(key.rlike(r"^\.|\.$|\.\."), "dots"), F.when(~F.size(F.split(key, r"\.")).between(2, 5), "parts"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def diagnostic_parts(message: Column) -> Column:
    """(key, locale) named in a diagnostic's message as 'key' and [locale]."""
    return F.struct(F.regexp_extract(message, r"['\"]([A-Za-z0-9_.\-]+)['\"]", 1).alias("key"), F.regexp_extract(message, r"\[([A-Za-z\-]+)\]", 1).alias("locale"))


def component_key(path: Column, key: Column) -> Column:
    """The key that a reference in a component's file should have: components.<Name> before its segments, without a repeated
    name, a leading app or a suffix for the kind; null if fewer than two segments are left."""
    name = F.nullif(F.regexp_replace(F.regexp_extract(path, r"(?i)(?:^|/)components/([^/]+)", 1), r"(?i)\.(tsx|ts|jsx|js|vue|svelte)$", ""), F.lit(""))
    drop_first = lambda a, word: F.when(F.lower(F.get(a, F.lit(0))) == word, F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(a)
    given = F.filter(F.split(F.regexp_replace(key, r"(?i)(_text|_label|_title|_message|_placeholder)$", ""), r"\."), lambda s: s != "")
    rest = F.when(name.isNull(), given).otherwise(drop_first(drop_first(given, F.lower(name)), F.lit("app")))
    clean = F.filter(F.transform(rest, lambda s: F.lower(F.regexp_replace(F.regexp_replace(s, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))), lambda s: s != "")
    parts = F.concat(F.when(name.isNull(), F.array().cast("array<string>")).otherwise(F.array(F.lit("components"), name)), clean)
    return F.when(F.size(parts) >= 2, F.array_join(parts, "."))


# Words in keys that speak of failure, of success, of an action, of a state; and pairs of opposites
FAILURE = (
    "failed failure error unable cannot could_not not_able invalid wrong incorrect bad missing absent unsuccessful unavailable inaccessible forbidden denied "
    "rejected declined refused blocked no_ not_ non_ un_ in_ dis_ mis_ anti_ contra_ counter_ de_ revert reset broken crashed corrupted damaged lost stolen "
    "expired timeout cancelled aborted empty void null undefined none nothing zero blank clear"
).split()
SUCCESS = "success complete done finished ready ok good valid correct available accessible allowed permitted granted approved accepted confirmed verified active alive working functional operational running loaded saved stored full filled populated prepared initialized started launched".split()
ACTION = (
    "import export save load create delete add remove edit modify update change replace show hide display reveal conceal open close start stop begin end finish "
    "terminate submit cancel confirm reject accept approve deny allow forbid grant revoke enable disable activate deactivate turn_on turn_off switch toggle power "
    "connect disconnect link join leave enter exit login logout signin signout upload download send receive transmit transfer copy move rename duplicate install "
    "setup teardown build destroy compile execute run halt lock secure encrypt decrypt protect guard increase decrease grow shrink expand contract magnify minify "
    "zoom_in zoom_out merge split combine separate divide unite group"
).split()
STATE = "active enabled disabled on off open closed visible hidden shown busy idle waiting pending processing loading saving deleting updating online offline connected disconnected synced linked locked secured protected focused selected checked marked".split()
OPPOSITES = (
    "import-export save-load create-delete add-remove show-hide display-conceal open-close start-stop begin-end submit-cancel confirm-reject approve-deny enable-disable "
    "activate-deactivate turn_on-turn_off switch-toggle success-failure enabled-disabled on-off visible-hidden connect-disconnect login-logout upload-download "
    "install-uninstall lock-unlock increase-decrease expand-contract merge-split join-separate"
).split()


def opposite(a: Column, b: Column) -> Column:
    """Whether two keys mean the contrary: one holds a word of a pair and the other its opposite, or one speaks of failure
    and the other of an action, a success or a state."""
    x, y = F.lower(a), F.lower(b)
    says = lambda key, words: key.rlike("|".join(words))
    out = (says(x, FAILURE) & says(y, [*ACTION, *SUCCESS, *STATE])) | (says(y, FAILURE) & says(x, [*ACTION, *SUCCESS, *STATE]))
    for pair in OPPOSITES:
        p, q = pair.split("-")
        out = out | (x.contains(p) & y.contains(q)) | (x.contains(q) & y.contains(p))
    return out


def key_likeness(a: Column, b: Column) -> Column:
    """similarity(), but 0 for keys that mean the contrary."""
    return F.when(a == b, 1.0).when(F.abs(F.size(F.split(a, r"\.")) - F.size(F.split(b, r"\."))) > 1, 0.1).when(opposite(a, b), 0.0).otherwise(similarity(a, b))
