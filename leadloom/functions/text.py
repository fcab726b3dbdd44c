"""Text cleaning as native column expressions."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

from leadloom.functions import fixed

# white space the way Unicode text needs it, spelled out so that the classes mean the same in every engine
SPACE_CHARS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = f"[{SPACE_CHARS}]"
SPACES = "".join(chr(n) for n in [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])  # the same
WORD = r"[\p{L}\p{N}_]"
TAG = r"</?[A-Za-z][^>]*>|<![^>]*>|<\?[^>]*>"
HIDDEN = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<template\b[^>]*>.*?</template\s*>"

# the same markup for long pages: one look at the bracket decides, not one look per kind of tag at every character
_TAG = r"<(?:/?[A-Za-z]|[!?])[^>]*>"
_HIDDEN = r"(?is)<(?:!--.*?-->|script\b[^>]*>.*?</script\s*>|style\b[^>]*>.*?</style\s*>|template\b[^>]*>.*?</template\s*>)"
_NOT_PRINTED = "(?![!-~])"  # put before a pattern that can only begin with white space or a mark: most characters end here
_NO_LONE_BLANK = _NOT_PRINTED + "(?! [!-~])"  # the same for one that a blank alone cannot begin either: the blanks between words end here too


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), 0)


def pinned(c: Column) -> Column:
    """``c`` computed where it stands.

    A filter on a computed column is otherwise moved below the projections
    that make its inputs, taking copies of all their expressions along.  The
    always-true condition is one the optimizer does not move.
    """
    return F.when(F.monotonically_increasing_id() >= 0, c)


def some(c: Column) -> Column:
    """Null instead of the empty string; ``c`` is computed once."""
    return F.get(F.filter(F.array(c), lambda v: v != ""), 0)


def first_filled(*cols: Column) -> Column:
    """First non-empty value, else the empty string; later values are only computed when needed."""
    return F.coalesce(*[some(c) for c in cols], F.lit(""))


def fill_missing(c: Column, *others: Column) -> Column:
    """The field itself when it has a value, else the first of the others that has one."""
    return F.when(c != "", c).otherwise(first_filled(*others))


def quote(literal: str) -> str:
    """A literal as a regex fragment, in the syntax Java and RE2 share."""
    return "".join(ch if ch.isalnum() or ch in " _@/&\"'%#,:;<>=~`!" or ord(ch) > 127 else "\\" + ch for ch in literal)


def any_of(literals: list[str], longest_first: bool = True) -> str:
    """Alternation of literals; longest first so a shorter entry never hides a longer one."""
    ordered = sorted(dict.fromkeys(literals), key=lambda s: (-len(s), s)) if longest_first else literals
    return "|".join(quote(s) for s in ordered)


def any_by_letter(literals: list[str]) -> str:
    """``any_of`` with the entries of one first letter together: one look at the letter passes over all others."""
    heads: dict[str, list[str]] = {}
    for s in sorted(dict.fromkeys(literals), key=lambda s: (-len(s), s)):
        heads.setdefault(s[0], []).append(s[1:])
    return "|".join(quote(h) + (f"(?:{'|'.join(map(quote, rest))})" if any(rest) else "") for h, rest in sorted(heads.items()))


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def holds_any(v: Column, literals: list[str]) -> Column:
    """``contains_any`` of a column that is at hand."""
    hit = F.contains(v, F.lit(literals[0]))
    for literal in literals[1:]:
        hit = hit | F.contains(v, F.lit(literal))
    return hit


def contains_any(c: Column, literals: list[str]) -> Column:
    return bind(c, lambda v: holds_any(v, literals))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(c, pattern, group)


def extract_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def unicode(pattern: str, flags: str = "") -> str:
    """The pattern with Unicode white space, word characters and boundaries.

    Classes are spelled out; the much slower Unicode mode is only switched on
    where a word boundary needs it.
    """
    out, in_class, at = [], False, 0
    while at < len(pattern):
        two = pattern[at:at + 2]
        if two == r"\s":
            out.append(SPACE_CHARS if in_class else SPACE)
        elif two == r"\w":
            out.append(r"\p{L}\p{N}_" if in_class else WORD)
        elif two[0] == "\\":
            out.append(two)
        else:
            in_class = (in_class or two[0] == "[") and two[0] != "]"
            out.append(two[0])
        at += 2 if two[0] == "\\" else 1
    flags += "U" if r"\b" in pattern else ""
    return (f"(?{flags})" if flags else "") + "".join(out)


def unicode_i(pattern: str) -> str:
    return unicode(pattern, "i")


def squeeze(c: Column) -> Column:
    """Runs of white space to one blank; a blank alone is not touched."""
    return F.trim(F.regexp_replace(c, rf"{_NO_LONE_BLANK}(?: {SPACE}++|[{SPACE_CHARS}&&[^ ]]{SPACE}*+)", " "))


def py_title(c: Column) -> Column:
    """Title case that starts a new word after every non-letter."""
    runs = extract_all(c, r"\p{L}+|[^\p{L}]+")
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def norm_key(c: Column) -> Column:
    """Comparison key: lower case, letters, digits and underscore only."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]", "")


def slugify(c: Column) -> Column:
    kept = F.regexp_replace(squeeze(F.lower(c)), rf"[^\p{{L}}\p{{N}}_{SPACE_CHARS}-]", "")
    return F.regexp_replace(F.regexp_replace(kept, rf"[{SPACE_CHARS}_-]+", "-"), "^-+|-+$", "")


# --- entities --------------------------------------------------------------

_NAMED = ",".join(f'"{name}":{code}' for name, code in sorted(name2codepoint.items()))


def _char(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def unescape(c: Column) -> Column:
    """Decode named and numeric character references in one pass.

    Only rows that hold an ampersand pay for the tokenisation.
    """
    named = F.from_json(F.lit("{" + _NAMED + "}"), "map<string,int>")

    def decode(token: Column) -> Column:
        code_of = F.coalesce(
            F.conv(F.nullif(extract(token, r"^&#[xX]([0-9a-fA-F]{1,6});?$"), F.lit("")), 16, 10).cast("int"),
            F.nullif(extract(token, r"^&#([0-9]{1,7});?$"), F.lit("")).cast("int"),
            F.try_element_at(named, F.nullif(extract(token, r"^&([A-Za-z][A-Za-z0-9]*);$"), F.lit(""))),
        )
        def shown(code: Column) -> Column:
            usable = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
            return F.when(usable, _char(code)).when(token == "&apos;", F.lit("'")).otherwise(token)

        return bind(code_of, shown)

    def decoded(text: Column) -> Column:
        tokens = extract_all(text, r"&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[A-Za-z][A-Za-z0-9]*;|[^&]+|&")
        return F.array_join(F.transform(tokens, lambda x: F.when(x.startswith("&"), decode(x)).otherwise(x)), "")

    return bind(c, lambda text: F.when(F.instr(text, "&") > 0, decoded(text)).otherwise(text))


def clean_text(c: Column) -> Column:
    """Tags to spaces, entities decoded twice, control characters out, spaces squeezed.

    Plain text without a tag, an ampersand or two blanks in a row has only its ends trimmed.
    """
    control = r"[\x00-\x1f\x7f&&[^\t\n\r]]"

    def cleaned(text: Column) -> Column:
        untagged = F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, "<[^>]+>", " ")).otherwise(text)
        plain = bind(unescape(unescape(untagged)), lambda x: F.when(x.rlike(control), F.regexp_replace(x, control, "")).otherwise(x))
        return squeeze(plain)

    return bind(c, lambda text: F.when(F.contains(text, F.lit("  ")) | text.rlike(r"[^ !-%'-;=-~]"), cleaned(text)).otherwise(F.trim(text)))


def clean_text_basic(c: Column) -> Column:
    return F.regexp_replace(squeeze(c), r"[\x00-\x1f\x7f-\x9f]", "")


def sanitize(c: Column) -> Column:
    return squeeze(F.translate(c, "<>", ""))


# --- text quality ----------------------------------------------------------

def is_garbled(c: Column) -> Column:
    foreign = F.length(F.regexp_replace(c, r"[\x00-\x7F]++", ""))
    return c.rlike(r"(?![ -~])(?:[\x00-\x1f\x7f-\x{9f}]|[\x{c0}-\x{ff}]{3,}|[\x{fffc}-\x{ffff}])") | (
        (foreign > F.length(c) * F.lit(0.3)) & (foreign > 10)
    )


def is_meaningful(c: Column) -> Column:
    letters = F.length(F.regexp_replace(c, "[^a-zA-Z]++", ""))
    two_words = c.rlike("[!-~] [!-~]") | c.rlike(rf"[^{SPACE_CHARS}]{SPACE}+[^{SPACE_CHARS}]")  # most texts need only the first look
    return (F.length(c) >= 5) & two_words & (letters * 2 >= F.length(c))


def is_valid_description(c: Column) -> Column:
    """True for empty text too: nothing to object to."""
    return (c == "") | ((F.length(c) >= 30) & ~contains_any(F.lower(c), fixed.LOREM) & ~is_garbled(c))


# --- urls ------------------------------------------------------------------

def url_host(c: Column) -> Column:
    return extract(c, r"^https?://([^/?#]*)")


def with_scheme(c: Column) -> Column:
    return F.when(c.rlike("^https?://"), c).otherwise(F.concat(F.lit("https://"), c))


def is_valid_url(c: Column) -> Column:
    url = with_scheme(c)
    host = url_host(url)
    return (c != "") & F.contains(host, F.lit(".")) & (F.length(host) >= 5) & ~url.rlike(r"[{}\\^`~\[\]|]")


def normalize_url(c: Column) -> Column:
    """Lower host without www., no trailing slash, query kept, fragment dropped."""
    value = F.trim(c)
    url = with_scheme(value)
    parts = r"^(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?"
    host = F.regexp_replace(F.lower(extract(url, parts, 2)), r"^www\.", "")
    # parameters of the last path segment are not part of the path
    path = F.regexp_replace(F.regexp_replace(extract(url, parts, 3), ";[^/]*$", ""), "/+$", "")
    query = F.nullif(extract(url, parts, 4), F.lit("?"))
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit("")).otherwise(
        F.concat(extract(url, parts, 1), F.lit("://"), host, path, F.coalesce(query, F.lit("")))
    )


def domain_of(c: Column) -> Column:
    return F.replace(F.lower(url_host(c)), F.lit("www."), F.lit(""))


def url_path(c: Column) -> Column:
    return F.regexp_replace(extract(c, r"^https?://[^/?#]*([^?#]*)"), ";[^/]*$", "")


# --- html as text ----------------------------------------------------------

def page_text(html: Column) -> Column:
    """Visible text pieces joined by one space; white space inside a piece is kept."""
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, "\x01")
    marked = unescape(F.regexp_replace(shown, _TAG, "\x01"))
    joined = F.regexp_replace(marked, rf"{_NO_LONE_BLANK}{SPACE}*+\x01[{SPACE_CHARS}\x01]*+", " ")
    return F.btrim(joined, F.lit(SPACES))


def page_title(html: Column) -> Column:
    return squeeze(unescape(extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>")))


def meta_content(html: Column, attribute: str, value: str) -> Column:
    """Content of the first meta tag with the given attribute, whatever the attribute order."""
    tag = extract(html, rf"(?is)(<meta\b[^>]*\b{attribute}\s*=\s*[\"']?{quote(value)}[\"'\s/>][^>]*>?)")
    content = F.regexp_replace(extract(tag, r"(?is)\bcontent\s*=\s*(\"[^\"]*\"|'[^']*')"), "^[\"']|[\"']$", "")
    return F.trim(unescape(content))


def raw_text(html: Column) -> Column:
    """Text pieces joined by one space with their own white space, line breaks included."""
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, "\x01")
    return F.regexp_replace(unescape(F.regexp_replace(shown, _TAG, "\x01")), "\x01+", " ")


def fragment_text(fragment: Column, glue: str) -> Column:
    """Text of a piece of markup: pieces trimmed and joined by ``glue``."""
    marked = unescape(F.regexp_replace(F.regexp_replace(fragment, _HIDDEN, "\x01"), _TAG, "\x01"))
    edges = F.regexp_replace(marked, rf"^(?:{SPACE}|\x01)+|(?:{SPACE}|\x01)+$", "")
    return F.regexp_replace(edges, rf"{SPACE}*(?:\x01{SPACE}*)+", glue)


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of a link found on the page ``base``."""
    scheme = extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):")
    origin = extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)")
    path = extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)")
    folder = F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "[^/]*$", "")).otherwise("/")
    joined = (
        F.when(href == "", base)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(origin, path, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .otherwise(F.concat(origin, folder, href))
    )
    head = extract(joined, r"^([^/]*//[^/?#]*)")
    steps = F.split(extract(joined, r"^[^/]*//[^/?#]*/([^?#]*)"), "/")
    tail = extract(joined, r"^[^?#]*([?#].*)$")
    kept = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(s == ".", done).otherwise(F.concat(done, F.array(s))),
    )
    last_is_dots = F.try_element_at(steps, F.lit(-1)).isin(".", "..")
    tidy = F.concat(head, F.lit("/"), F.array_join(kept, "/"),
                    F.when(last_is_dots & (F.size(kept) > 0), F.lit("/")).otherwise(""), tail)
    absolute = href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    return F.when(absolute, href).when(joined.rlike(r"/\.\.?(?:[/?#]|$)"), tidy).otherwise(joined)


def unwrap_redirect(href: Column) -> Column:
    """Target of a search-engine redirect link; protocol-relative links become https."""
    raw = extract(href, r"[?&]uddg=([^&#]*)")
    once = F.coalesce(F.try_url_decode(raw), raw)
    twice = F.coalesce(F.try_url_decode(F.replace(once, F.lit("+"), F.lit("%2B"))), once)
    return (
        F.when(F.contains(href, F.lit("duckduckgo.com/l/")) & (raw != ""), twice)
        .when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .otherwise(F.coalesce(href, F.lit("")))
    )
