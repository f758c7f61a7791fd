"""Text functions as Column expressions: tokens, names, signatures, slugs, routers, markup."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L

Text = Column | str


def col(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def filled(x: Text) -> Column:
    return F.coalesce(col(x), F.lit(""))


def strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


# longer lists are looped over: written out one by one they make a method too large to compile
WRITTEN_OUT = 6


def any_of(text: Column, words: list[str]) -> Column:
    """Whether some word is a substring."""
    if len(words) > WRITTEN_OUT:
        return F.exists(strings(words), lambda w: F.contains(text, w))
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def count_of(text: Column, words: list[str]) -> Column:
    """How many of the words are substrings."""
    if len(words) > WRITTEN_OUT:
        return F.size(F.filter(strings(words), lambda w: F.contains(text, w)))
    return reduce(lambda a, b: a + b, (F.contains(text, F.lit(w)).cast("int") for w in words))


def hits(text: Column, words: list[str], most: int = 6) -> Column:
    """The first words present, in the list's order, joined by commas."""
    return F.array_join(F.slice(F.filter(strings(words), lambda w: F.contains(text, w)), 1, most), ", ")


def squeeze(text: Text) -> Column:
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def tokens(text: Text) -> Column:
    found = F.regexp_extract_all(F.lower(filled(text)), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(L.STOP_WORDS))


def name_key(name: Text, suffixes: str = L.SUFFIXES_SIGNATURE) -> Column:
    """A company name without signs and legal suffixes."""
    plain = F.regexp_replace(F.lower(filled(name)), "[^a-z0-9 ]+", " ")
    return squeeze(F.regexp_replace(plain, suffixes, " "))


def entity_key(name: Text) -> Column:
    """As name_key with the graph's suffixes, and without stop words."""
    words = F.split(name_key(name, L.SUFFIXES_ENTITY), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~F.array_contains(strings(L.ENTITY_STOP), w)), " ")


def signature(company: Text, authority: Text, suffixes: str = L.SUFFIXES_SIGNATURE) -> Column:
    who = F.lower(F.trim(filled(authority)))
    both = F.concat_ws("|", F.nullif(name_key(company, suffixes), F.lit("")), F.nullif(who, F.lit("")))
    return F.coalesce(F.nullif(both, F.lit("")), F.lit("unknown"))


def cluster_key(company: Text, authority: Text, date: Text, amount: Text) -> Column:
    lakh = F.coalesce(F.bround(col(amount) / 100000, 0).cast("bigint").cast("string"), F.lit(""))
    return F.concat_ws("|", name_key(company), F.left(F.lower(F.trim(filled(authority))), F.lit(12)), F.left(filled(date), F.lit(7)), lakh)


@cache
def _foldings() -> tuple[dict[str, str], dict[str, str]]:
    """What compatibility decomposition leaves of a sign in ASCII: of those that give one sign, and of those that give more."""
    made = {chr(c): unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode() for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000}
    return {c: a for c, a in made.items() if len(a) == 1}, {c: a for c, a in made.items() if len(a) > 1}


def _class(signs: list[str]) -> str:
    """A pattern of one of the signs, by ranges: the engine tries the parts of a class one after the other."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, signs)):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]"


def ascii_fold(text: Text) -> Column:
    """Signs as their compatibility decomposition without what is not ASCII."""
    one, many = _foldings()
    ligatures = F.create_map(*[F.lit(x) for kv in many.items() for x in kv])
    # most of a text is ASCII, and goes before ligatures are sought; each kind found is replaced in the whole text at once
    found = F.array_distinct(F.regexp_extract_all(F.regexp_replace(filled(text), r"[\x00-\x7F]+", ""), F.lit(_class(list(many))), F.lit(0)))
    apart = F.reduce(found, filled(text), lambda out, c: F.replace(out, c, F.try_element_at(ligatures, c)))
    plain = F.regexp_replace(F.translate(apart, "".join(one), "".join(one.values())), r"[^\x00-\x7F]+", "")
    return F.when(filled(text).rlike(r"[^\x00-\x7F]"), plain).otherwise(filled(text))


def slug(text: Text, words: int = 6) -> Column:
    """Letters without accents and in compatible form; other signs separate; stop words go."""
    parts = F.split(F.trim(F.regexp_replace(F.lower(ascii_fold(text)), "[^a-z0-9]+", " ")), " ")
    kept = F.filter(parts, lambda w: (w != "") & ~F.array_contains(strings(L.SLUG_STOP), w))
    # named once: a comparison beside it would have the whole text folded twice
    return F.regexp_replace(F.array_join(F.slice(kept, 1, words), "-"), "^$", "case")


def authority_short(authority: Text) -> Column:
    known = F.create_map(*[F.lit(x) for kv in L.AUTHORITY_SHORT.items() for x in kv])
    return F.coalesce(F.try_element_at(known, filled(authority)), slug(authority, 2))


def case_slug(company: Text, authority: Text, date: Text) -> Column:
    month = F.regexp_replace(F.left(filled(date), F.lit(7)), "-", "")
    # neither slug is ever empty; a comparison would have each made twice
    return F.concat_ws("-", slug(company, 4), authority_short(authority), F.nullif(month, F.lit("")))


def route(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The first rule with a word in the text."""
    out = None
    for name, words in rules:
        out = F.when(any_of(text, words), name) if out is None else out.when(any_of(text, words), name)
    return out.otherwise(default)


def section_of(text: Text, authority: Text) -> Column:
    return route(F.lower(F.concat_ws(" ", filled(authority), filled(text))), L.SECTION_RULES, L.SECTION_DEFAULT)


def sector_of(text: Text) -> Column:
    return route(F.lower(filled(text)), L.SECTOR_RULES, L.SECTOR_DEFAULT)


def badge(outcome: Text) -> Column:
    return route(F.lower(filled(outcome)), L.BADGES, "badge-other")


def entity_type(name: Text) -> Column:
    raw, key = F.lower(filled(name)), entity_key(name)
    known = F.transform(strings(L.REGULATORS), lambda r: F.array_join(F.filter(F.split(squeeze(F.regexp_replace(F.regexp_replace(r, "[^a-z0-9 ]+", " "), L.SUFFIXES_ENTITY, " ")), " "), lambda w: ~F.array_contains(strings(L.ENTITY_STOP), w)), " "))
    return (
        F.when(raw.rlike(L.CASE_CAPTION), "case")
        .when(any_of(raw, L.GENERIC_ADDRESSEES), "generic")
        .when(F.array_contains(known, key) | any_of(key, L.REGULATOR_WORDS), "regulator")
        .when(any_of(key, L.COURT_WORDS), "court")
        .when(any_of(key, L.STATUTE_WORDS), "statute")
        .otherwise("company")
    )


def authorities(raw: Text) -> Column:
    """The bodies that an authority string names."""
    return F.filter(F.transform(F.split(filled(raw), L.AUTHORITY_SEPARATOR), lambda p: F.trim(p)), lambda p: F.length(p) > 1)


def distinctive_tokens(name: Text) -> Column:
    return F.filter(F.split(entity_key(name), " "), lambda t: (F.length(t) > 2) & ~F.array_contains(strings(L.WEAK_TOKENS), t))


def excerpt(text: Text, needle: Text, width: int = 260) -> Column:
    """Text around the first case-insensitive occurrence; empty without one."""
    at = F.instr(F.lower(col(text)), F.lower(col(needle)))
    return F.when(at > 0, squeeze(F.substring(col(text), F.greatest(F.lit(1), at - width), F.lit(2 * width)))).otherwise("")


def visible_text(html: Text) -> Column:
    """Without scripts, styles and tags."""
    bare = F.regexp_replace(filled(html), r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    return squeeze(F.regexp_replace(bare, r"(?s)<[^>]+>", " "))


def headings(html: Text, most: int = 6) -> Column:
    found = F.regexp_extract_all(filled(html), F.lit(r"(?is)<h[12][^>]*>(.*?)</h[12]>"), F.lit(1))
    return F.slice(F.transform(found, lambda h: squeeze(F.regexp_replace(h, r"(?s)<[^>]+>", " "))), 1, most)


def json_object(text: Text) -> Column:
    """From the first brace to the last."""
    return F.nullif(F.regexp_extract(filled(text), r"(?s)\{.*\}", 0), F.lit(""))


def headline(title: Text) -> Column:
    """Without the publisher after the last dash."""
    return F.regexp_replace(filled(title), r"^(.*) - .*$", "$1")


def citations(text: Text) -> Column:
    """Numbers of the act's listed sections that a reference points at; none of other statutes."""
    low = F.lower(filled(text))
    own = F.contains(low, F.lit("dpdp")) | F.contains(low, F.lit("digital personal data"))
    found = F.array_distinct(F.regexp_extract_all(filled(text), F.lit(L.SECTION_REFERENCE), F.lit(1)))
    listed = F.filter(found, lambda n: F.array_contains(strings(list(L.STATUTE_SECTIONS)), n))
    return F.when(own | ~any_of(low, L.OTHER_STATUTES), listed).otherwise(F.array().cast("array<string>"))
