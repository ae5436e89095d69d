"""The rules on texts as SQL, for the queries that run them over whole tables."""

from __future__ import annotations

from ..functions import validate as val


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def met(*patterns: str, t: str = "t") -> str:
    """Whether t meets one of the patterns."""
    return "(" + " or ".join(f"regexp_matches({t}, {_lit(p)})" for p in patterns) + ")"


def times(pattern: str) -> str:
    return f"len(regexp_extract_all(t, {_lit(pattern)}))"


def _any(words: list[str]) -> str:
    return "|".join(words)


_WORDS = "list_filter(string_split_regex(t, '[ \\n\\t\\r\\f\\x0b]+'), lambda w: w <> '')"
_ONE = f"regexp_replace({_WORDS}[1], '[.,:;!?]+$', '')"
_TAKEN = " + ".join(f"coalesce(list_sum(list_transform(regexp_extract_all(t, {_lit(p)}), lambda x: length(x))), 0)" for p in val.PLACEHOLDERS)
_LEFT = "t"
for _p in val.PLACEHOLDERS:
    _LEFT = f"regexp_replace({_LEFT}, {_lit(_p)}, '', 'g')"

UUID = met("^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$", t="lower(t)")
#: Shapes of single words, by name.
SHAPES = {
    "path": met(r"(?i)\.(js|ts|jsx|tsx|vue|json|css|html|php|py|go|md|txt|png|jpg|svg|pdf|xml|yml|yaml)$", r"^\.{0,2}/[A-Za-z0-9_.-]+(/[A-Za-z0-9_.-]+)*$", r"^[A-Za-z]:[/\\]"),
    "uuid": UUID, "hex": met("^#[0-9a-f]{3,8}$", t="lower(t)"), "query": met(r"(?i)^[?&]?[a-z_][a-z0-9_]*=[^&\s]*", "%[0-9A-F]{2}"),
    "version": met(r"(?i)^v?[0-9]+\.[0-9]+(\.[0-9]+)?(-[a-z0-9.-]+)?(\+[a-z0-9.-]+)?$", r"^[0-9]{4}\.[0-9]{1,2}(\.[0-9]+)?$"),
    "identifier": f"({UUID} or {met('(?i)^(0x)?[0-9a-f]{16,}$', '(?i)^(sk|pk|api|token|key|auth)[-_][a-z0-9]{20,}$', '^[A-Za-z0-9_-]{21}$')} or ({met('^[A-Za-z0-9+/=_-]{20,}$')} and {times('(?i)[aeiou]')} < length(t) * 0.4) or ({met(r'^[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+[.][A-Za-z0-9_-]+$')} and length(t) > 50) or ({met('(?i)^[a-z0-9_-]{12,}$')} and {times('(?i)[a-z]')} >= 3 and {times('[0-9]')} >= 3))",
    "env": f"({met('^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$', r'^\$\{?[A-Z_][A-Z0-9_]*\}?$')} or t in ('PATH', 'HOME', 'USER', 'SHELL', 'LANG', 'PWD', 'PORT', 'HOST', 'DEBUG', 'ENV'))",
    "pair": met(r"^[a-zA-Z_][a-zA-Z0-9_.-]*\s*=\s*\S+$", r"^[a-zA-Z_][a-zA-Z0-9_.-]*:\s*[\[{]", r"^\[[a-zA-Z_][a-zA-Z0-9_. -]*\]$", r'^"[^"]+"\s*:\s*.+$'),
    "argument": met("(?i)^-{1,2}[a-z][a-z0-9-]*(=.*)?$", "^[A-Z_][A-Z0-9_]*="), "dsn": met("(?i)^(mongodb|postgresql|postgres|mysql|redis|sqlite)://", "(?i)^(Server|Data Source|Initial Catalog|User ID|Password)="),
    "date": met(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9:.]+(Z|[+-][0-9:]+)?)?$", "^[YMDHhmsAaZ/:., -]*(YYYY|MM|DD|HH|mm|ss)[YMDHhmsAaZ/:., -]*$", "^[0-9]{10}([0-9]{3})?$"), "numeric": met(r"^[+-]?[0-9][0-9\s.,()/-]*%?$"),
    "url": met(r"^www\.", r"^[a-z0-9][a-z0-9-]*(\.[a-z0-9-]+)*\.(com|org|net|edu|gov|io|dev|app|info|de|fr|es|uk)$", r"^(localhost|127\.0\.0\.1|0\.0\.0\.0)", r"^([0-9]{1,3}\.){3}[0-9]{1,3}(:[0-9]+)?", r"^[a-z0-9.-]+:[0-9]{2,5}(/|$)", r"^/[a-z0-9_.-]+(/[a-z0-9_.-]*)*(\?\S*)?$", "^(" + _any([s.replace(".", r"\.") for s in val.URL_STARTS]) + ")", t="lower(t)"),
}
PLAIN = "trim(replace(translate({t}, '‘’‚‛“”„‟–—―  ', '''''''''\"\"\"\"---  '), '…', '...'))"
BASIC = f"(length(t) >= 2 and {met('[[:alpha:]]', chr(92) + 'p{L}')} and not (not {met(chr(92) + 's')} and lower(t) in ({', '.join(_lit(w) for w in val.NEVER)})))"
BALANCED = "(" + " and ".join(f"length(replace(t, '{a}', '')) = length(replace(t, '{b}', ''))" for a, b in ("()", "[]", "{}")) + f" and ((length(t) - length(replace(t, '''', ''))) - {times('[A-Za-z]' + chr(39) + '[A-Za-z]')}) % 2 = 0 and (length(t) - length(replace(t, '\"', ''))) % 2 = 0)"
PLACEHOLDER_ONLY = f"(t = '' or ({_TAKEN}) > length(t) * 0.7 or not regexp_matches(regexp_replace({_LEFT}, '[\\s[:punct:]]', '', 'g'), '\\p{{L}}'))"
UI = met(f"(?i)^({_any(val.ACTIONS)})", rf"(?i)^({_any(val.REPORTS)})\s+", f"(?i)({_any(val.STATES)})", rf"(?i)^({_any(val.PROMPTS)})\s+(a|an|the|your)\s+", r"(?i)^(last|past|next|in|within|after|before)\s+\d+\s+(second|minute|hour|day|week|month|year)s?\b", rf"(?i)^({_any(val.HINTS)})\s+", r"(?i)\(recommended\)$")
CSS = met(r"^[a-z-]+\s*:\s*[^;{}]+;", r"\{[^{}]*:[^{}]*;[^{}]*\}", r"^@(media|import|keyframes|font-face|apply)\b", r"^(calc|var|rgba?|hsla?|url)\(", r"^-?[0-9.]+(px|em|rem|vh|vw|%|deg|ms|s|fr)$", r"^[.#][a-zA-Z_-][\w-]*(\s*[,>+~]\s*[.#]?[\w-]+)*$")
SHEET = met(r"^(R[0-9]+C[0-9]+|\$?[A-Z]{1,3}\$?[0-9]+(:\$?[A-Z]{1,3}\$?[0-9]+)?)$")
CODE = met(r"^(const|let|var|function|class|import|export|return|if|for|while)\b.*[;{(=]", "=>", r"^[a-zA-Z_$][\w$]*(\.[a-zA-Z_$][\w$]*)+\(?\)?$", r"^[a-z]+[A-Z]\w*$", r"^[a-z0-9]+(_[a-z0-9]+)+$", r"(===|!==|&&|\|\|)", r"^[\[{].*[\]}]$")
HTML = met(r"</?[a-zA-Z][^>]*>", r"^&[a-z]+;$", r"^[a-z-]+=[\"'][^\"']*[\"']$")
HUMAN = f"""(case when t = '' then false when regexp_matches(t, '[^\\x00-\\x7F]') and regexp_matches(t, '\\p{{L}}') then true
when len({_WORDS}) = 1 then regexp_matches({_ONE}, '^[A-Z][a-zA-Z0-9'']*$') or (regexp_matches({_ONE}, '^[A-Z0-9_]+$') and regexp_matches({_ONE}, '[A-Z]')) or lower({_ONE}) in ({', '.join(_lit(w) for w in val.LABELS)})
else len(list_filter(list_transform({_WORDS}, lambda w: regexp_replace(w, '[^A-Za-z0-9_]', '', 'g')), lambda w: regexp_matches(w, '(?i)[aeiou]') and length(w) >= 2)) >= len({_WORDS}) * 0.5 end)"""
TECHNICAL = "(" + " or ".join(SHAPES[k] for k in ("uuid", "hex", "version", "identifier", "env", "argument", "date", "numeric")) + ")"
REASON = f"""case when not {BASIC} then 'basic_requirements' when not {BALANCED} then 'unbalanced_delimiters' when {PLACEHOLDER_ONLY} then 'placeholder_only'
when {UI} and not {CODE} and not {HTML} and not {SHAPES['url']} then null when {CSS} then 'css_content' when {SHEET} then 'spreadsheet_reference' when {CODE} then 'code_content' when {HTML} then 'html_content'
when {TECHNICAL} then 'technical_content' when not {HUMAN} then 'not_human_text' end"""
_BARE = r"regexp_replace(regexp_replace(t, '\{\{\s*[^}]+\s*\}\}', ' ', 'g'), '\{[A-Za-z0-9_]+(\.[A-Za-z0-9_]+)*\}', ' ', 'g')"
_REST = rf"trim(regexp_replace(regexp_replace({_BARE}, '[()\[\]{{}},.:;''\"!?_-]', ' ', 'g'), '\s+', ' ', 'g'))"
ONLY_PLACEHOLDERS = f"(t <> '' and (not regexp_matches({_REST}, '[A-Za-z]') or (length(regexp_replace({_REST}, '[^A-Za-z]', '', 'g')) <= 1 and length({_REST}) <= 3)))"
_SPARED = r"list_filter(string_split_regex(trim(regexp_replace(t, '\{[A-Za-z0-9_]+\}', '', 'g')), '\s+'), lambda w: w <> '')"
_DASHED = f"({met(r'{[A-Za-z0-9_]+}'.replace('{', chr(92) + '{').replace('}', chr(92) + '}'))} and len(list_filter({_SPARED}, lambda w: not regexp_matches(w, '(?i)^[a-z][a-z0-9]*(-[a-z0-9]+)+$'))) = 0)"
_PROGRAM = f"({met('[{};]')} and {met(chr(92) + 'b(' + _any(val.CODE_WORDS) + ')' + chr(92) + 'b')})"
_MUSTACHE = f"({met(r'\{\{\s*[^}]+\s*\}\}')} and {met(r'[?:]|\|\||&&|\.length\b')})"
_TOKEN = f"(not {met(chr(92) + 's')} and {met(r'[:\[\]]')} and {met(r'^[A-Za-z0-9:._\[\]-]+$')} and regexp_replace(t, '[\\[\\]]', '', 'g') <> '')"
_QUERY = f"(not {met(chr(92) + 's')} and {met(r'^[?#][A-Za-z0-9_.-]+=', r'^[A-Za-z0-9_.-]+=[^&]*(&[A-Za-z0-9_.-]+=[^&]*)+$')})"
_SNIPPET = f"({met(r'gtag\(')} or ({met('[{}]')} and {met(chr(91) + chr(39) + chr(34) + ']' + '[^' + chr(39) + chr(34) + ']+' + '[' + chr(39) + chr(34) + ']' + r'\s*:')}))"
INVALID = f"""({ONLY_PLACEHOLDERS} or {_DASHED} or {_PROGRAM} or {_MUSTACHE} or {_TOKEN} or {_QUERY} or {_SNIPPET} or length(t) = 1 or {met(
    r'\{[^}]*:[^;}]+;[^}]*\}', '(class|style)=["' + chr(39) + ']', r'@\w+\s*=', '^(' + _any(val.STYLE_NAMES) + r')[^;{]*;?$', '(?i)^(' + _any(val.FONT_CALLS) + r')\s*\([^)]+\)$',
    '(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$', '(?i)^(https?://|www' + chr(92) + '.)', '^/[A-Za-z0-9_/-]+$', r'^[A-Za-z]:[\\/][^ ]*$')})"""
_TOKENS = r"list_filter(string_split_regex(t, '\s+'), lambda w: w <> '')"
UTILITY = f"(len({_TOKENS}) >= 2 and len(list_filter({_TOKENS}, lambda w: not regexp_matches(w, '^[a-z0-9:]+(-[a-z0-9./\\[\\]]+)+$'))) = 0)"
