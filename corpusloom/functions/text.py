"""Column functions over text: cleaning, tokens, PII, URLs, flags. Built-in expressions only; whole texts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: prefix put before a query that is embedded.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "

#: Function words left out of full-text queries.
STOPWORDS = """a an the and or but if then else of to in on for with by at from as is are was were be been being have has
had do does did will would can could should may might must shall not no so than that this these those it its i you he she
we they them their his her my your our who whom which what when where how why also only just very too much more most such
each any all both some per via about into over under between during before after against der die das den dem des ein eine
einen einem einer eines und oder aber wenn dann sonst zu in auf für mit von bei aus an als ist sind war waren sein gewesen
haben hat hatte gehabt wird werden wurde würde kann können konnte soll sollen muss müssen nicht kein keine keinen keinem so
als dass diese dieser dieses es sie er wir ihr ihre ihrer ihres mein meine dein deine sein seine unser unsere euer eure wer
was wann wo wie warum auch nur sehr zu viel mehr meisten solche jeder jede jedes jeden alle beide manche pro über unter
zwischen während vor nach gegen bis um ohne durch wegen""".split()

#: Words that point without naming, and words that name a task of the domain.
PRONOUNS = "it that this there they them he she i my me we you when what how which then".split()
DOMAIN_WORDS = """visa visas aps blocked account sperrkonto university universities college admission admissions apply
application applications certificate passport insurance health permit residence housing enrollment enrolment semester degree
bachelor master tuition scholarship ielts student students documents requirements registration studying study embassy
consulate police""".split()

#: Terms that put a query out of the domain, and route triggers.
NEGATIVE_TERMS = ("japan", "stock trading", "algorithmic", "crypto", "recipe", "cooking", "nba", "football", "cricket", "python script for trading")
COMPARE_TERMS, COST_TERMS = ("vs", "compare", "difference"), ("cost", "budget", "expense", "fee")

_B, _E = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
#: PII classes in order. Word edges are spelt out for ASCII, as engines differ on them.
PII = (
    ("iban", _B + r"[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}" + _E, "[IBAN_REDACTED]"),
    ("iban_spaced", _B + r"[A-Z]{2}[0-9]{2}(?:\s[A-Z0-9]{4})+(?:\s[A-Z0-9]{2})?" + _E, "[IBAN_REDACTED]"),
    ("passport", _B + r"[A-PR-WY][1-9]\d\s?\d{4}[1-9]" + _E, "[PASSPORT_REDACTED]"),
    ("national_id", _B + r"[A-Z0-9]{2}[0-9]{7}" + _E, "[PASSPORT_REDACTED]"),
    (
        "dob",
        _B + r"(?:0?[1-9]|[12]\d|3[01])[/\-.](?:0?[1-9]|1[0-2])[/\-.](?:19[2-9]\d|200\d|201\d)" + _E
        + "|" + _B + r"(?:19[2-9]\d|200\d|201\d)[/\-.](?:0?[1-9]|1[0-2])[/\-.](?:0?[1-9]|[12]\d|3[01])" + _E,
        "[DOB_REDACTED]",
    ),
    ("phone", r"(?<![A-Z0-9])(?:\+|00)[1-9]\d{0,2}[\s\-.(]?\d{2,4}[\s\-.]?\d{3,4}[\s\-.]?\d{3,4}" + _E, "[PHONE_REDACTED]"),
    ("email", _B + r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}" + _E, "[EMAIL_REDACTED]"),
)


def strip(c: Column) -> Column:
    """Without white space at both ends, line ends and tabs included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def non_empty(parts: Column) -> Column:
    return F.filter(parts, lambda x: x != "")


def words(c: Column) -> Column:
    return non_empty(F.split(c, r"\s+"))


def squeeze(c: Column) -> Column:
    """Cleaning before lines are dropped: two odd characters go, bullets become dashes."""
    return F.translate(c, "\uf0b7\x00\uf06c", "-")


def tidy(c: Column) -> Column:
    """Cleaning after lines are dropped: blank lines and spaces are squeezed, lines of one or two visible characters go."""
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r" \n", "\n")
    lines = F.filter(F.split(c, "\n"), lambda x: ~F.length(strip(x)).between(1, 2))
    return strip(F.array_join(lines, "\n"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without_boilerplate(c: Column, longer_than: int = 5, most: int = 3) -> Column:
    """Without the lines that, trimmed, are longer than 5 characters and stand more than 3 times in the text; order kept.

    The lines are sorted to find those with equals three places on, so it costs n log n, not n squared.
    """

    def repeated(ordered: Column) -> Column:
        return F.array_distinct(F.filter(F.transform(ordered, lambda x, i: F.when(x == F.get(ordered, i + most), x)), lambda x: x.isNotNull()))

    def keep(lines: Column) -> Column:
        ordered = F.sort_array(F.filter(F.transform(lines, strip), lambda x: F.length(x) > longer_than))
        return let(let(ordered, repeated), lambda often: F.array_join(F.filter(lines, lambda x: ~F.array_contains(often, strip(x))), "\n"))

    return let(F.split(c, "\n"), keep)


def clean_text(c: Column) -> Column:
    """squeeze, without_boilerplate, tidy. Texts with combining marks want NFC first (operators.chunking.normalise)."""
    return tidy(without_boilerplate(squeeze(c)))


def tokens_floor(c: Column) -> Column:
    return F.floor(F.length(c) / 4)


def tokens_ceil(c: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(c) / 4))


def tokenize(c: Column) -> Column:
    """Lower-case tokens of letters, digits and hyphens; hyphenated words stay whole."""
    return non_empty(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s-]", " "), r"\s+"))


def tokenize_fts(c: Column) -> Column:
    """Content tokens of a full-text query: split at hyphens too, longer than one character, no function words."""
    parts = F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s-]", " "), r"[\s-]+")
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(STOPWORDS)])
    return F.filter(parts, lambda x: (F.length(x) > 1) & ~F.array_contains(stop, x))


#: What a text must hold to hold a match of the class; a cheap test before the pattern itself.
_HINTS = {
    "iban": "[A-Z]{2}[0-9]{2}", "iban_spaced": r"[A-Z]{2}[0-9]{2}\s", "passport": "[A-Z][1-9][0-9]", "national_id": "[0-9]{7}",
    "dob": "(?:19|20)[0-9]{2}", "phone": r"(?:\+|00)[1-9]", "email": "@",
}


def _masking(name: str, pattern: str, mark: str) -> Callable[[Column], Column]:
    return lambda c: F.when(c.rlike(_HINTS[name]), F.regexp_replace(c, pattern, mark)).otherwise(c)


def mask_pii(c: Column) -> Column:
    """Each class masked in turn; a text without the class's hint is passed on."""
    for name, pattern, mark in PII:
        c = let(c, _masking(name, pattern, mark))
    return c


def pii_counts(c: Column) -> dict[str, Column]:
    """Matches per class, each on the text in which the classes before are masked."""
    out = {}
    for name, pattern, mark in PII:
        out[name] = F.regexp_count(c, F.lit(pattern)).cast("long")
        c = F.regexp_replace(c, pattern, mark)
    return out


def query_hash(c: Column) -> Column:
    return F.sha2(F.lower(strip(c)), 256)


def source_key(name: Column, content_hash: Column, scheme: str = "doc") -> Column:
    return F.concat(F.lit(scheme + "://"), F.substring(content_hash, 1, 16), F.lit("/"), F.regexp_replace(F.lower(name), r"[^0-9A-Za-z_.\-]+", "_"))


def contains_any(c: Column, terms: Sequence[str]) -> Column:
    low = F.lower(c)
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(low, F.lit(t))
    return out


def vague(c: Column, most_words: int = 3) -> Column:
    """Empty, at most three words, or two pronouns without a word of the domain."""
    ws = F.transform(words(c), F.lower)
    pronouns = F.array(*[F.lit(w) for w in PRONOUNS])
    entity = F.exists(ws, lambda w: w.rlike(r"(?<![0-9a-z_])(?:" + "|".join(DOMAIN_WORDS) + r")(?![0-9a-z_])"))
    return (F.size(ws) <= most_words) | ((F.size(F.filter(ws, lambda w: F.array_contains(pronouns, w))) >= 2) & ~entity)


def coverage_score(text: Column, query: Column) -> Column:
    """0.7 of the share of query terms in the text and 0.3 of how early the first stands, at most 1; null without terms."""
    def score(terms: Column, low: Column, hits: Column) -> Column:
        first = F.array_min(F.transform(hits, lambda t: F.instr(low, t) - 1))
        early = F.when(F.size(hits) > 0, 1 - first / F.greatest(F.lit(1), F.length(low))).otherwise(F.lit(0.0))
        return F.when(F.size(terms) > 0, F.least(F.lit(1.0), F.lit(0.7) * F.size(hits) / F.size(terms) + F.lit(0.3) * early))

    def with_terms(low: Column) -> Column:
        return let(words(F.lower(query)), lambda terms: let(F.filter(terms, lambda t: F.contains(low, t)), lambda hits: score(terms, low, hits)))

    return let(F.lower(text), with_terms)


def url_flags(url: Column) -> dict[str, Column]:
    """http(s) only; a literal IPv4 host in a private, loopback, link-local or zero range; PDF or web."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)
    octet = [F.try_element_at(F.split(host, r"\."), F.lit(k)).try_cast("int") for k in (1, 2)]
    literal = host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    a, b = octet
    private = a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
    return {
        "is_http": url.rlike(r"^(?i:https?)://"),
        "is_private": F.coalesce(literal & private, F.lit(False)),
        "kind": F.when(F.lower(url).rlike(r"^pdf://|\.pdf$"), "pdf").otherwise("web"),
    }


def umlauts(c: Column) -> Column:
    return c.rlike("[äöüßÄÖÜ]")


#: Named entities that are decoded.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "ndash": "–", "mdash": "—", "hellip": "…", "uuml": "ü", "auml": "ä", "ouml": "ö", "szlig": "ß", "amp": "&"}


def _decode(c: Column) -> Column:
    """Numeric entities, then the named ones; an ampersand last, so that nothing is decoded twice."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)(.*?)(?:&#([xX]?[0-9a-fA-F]+);|\z)"), F.lit(1))
    codes = F.regexp_extract_all(c, F.lit(r"(?s).*?(?:&#([xX]?[0-9a-fA-F]+);|\z)"), F.lit(1))
    number = lambda code: F.when(F.lower(code).startswith("x"), F.conv(F.substring(code, 2, 8), 16, 10)).otherwise(code).try_cast("long")
    text = lambda code: F.when(number(code).between(1, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(number(code)), 8, "0")), "UTF-32"))
    c = F.when(F.contains(c, F.lit("&#")), F.array_join(F.zip_with(parts, codes, lambda p, k: F.concat(p, F.coalesce(text(k), F.lit("")))), "")).otherwise(c)
    for name, mark in ENTITIES.items():
        c = F.regexp_replace(c, f"(?i)&{name};", mark)
    return c


_NOISE = ("script", "style", "noscript", "svg", "head")
_LAYOUT = ("nav", "footer", "header", "aside")


def html_title(html: Column) -> Column:
    return F.substring(strip(_decode(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))), 1, 200)


def html_region(html: Column) -> Column:
    """The first main, else article, else body element, else all."""
    first = [F.regexp_extract(html, p, 0) for p in (r"(?is)<main[\s>].*?</main>", r"(?is)<article[\s>].*?</article>", r"(?is)<body[^>]*>.*?</body>")]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in first], html)


def html_text(html: Column) -> Column:
    c = html_region(html)
    for tag in _NOISE:
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*[^>]*>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    for tag in _LAYOUT:
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*[^>]*>", " ")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    c = F.regexp_replace(c, r"(?i)</(p|div|li|h1|h2|h3|h4|h5|h6|tr|blockquote)>", "\n")
    c = F.regexp_replace(c, r"(?i)<li[^>]*>", "- ")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    c = _decode(F.regexp_replace(c, r"(?i)&nbsp;", " "))
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r" *\n", "\n")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))
