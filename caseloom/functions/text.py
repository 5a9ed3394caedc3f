"""Clinical text: cleaning, narratives, tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom.config import ABBREVIATIONS, EMPTY_NARRATIVE, RISK_REACTIONS

# Letters, digits and underscore of any script; the usual ones come
# first because they decide soonest.
WORD = r"a-zA-Z0-9_\p{L}\p{N}"

# Letters that equal another one when case is ignored.
CASE_VARIANTS = {"I": "Iiİı", "S": "Ssſ"}


def _letters(letter: str) -> str:
    return f"[{CASE_VARIANTS.get(letter, letter + letter.lower())}]"


# What cleaned text holds besides letters, digits and underscores.
BETWEEN = r" \-.,()"


def _whole_word(terms: Sequence[str]) -> str:
    """Any of the terms in any case, as a whole word of a kept text that begins with a space.

    Only places behind a sign or a space are tried, so most of a text fails at one test.
    """
    starts = "".join(sorted({_letters(term[0])[1:-1] for term in terms}))
    bodies = "|".join("".join(_letters(c) for c in term) for term in terms)
    return rf"[{BETWEEN}](?=[{starts}])(?:{bodies})(?:[{BETWEEN}]|\z)"


# Places where a word begins or ends.
_EDGES = rf"(?<=[{WORD}])(?=[^{WORD}])|(?<=[^{WORD}])(?=[{WORD}])"


def _meaning(word: Column) -> Column:
    """What an abbreviation stands for, in any case; null for other words."""
    table = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    capitals = F.upper(F.translate(word, "".join(v[2:] for v in CASE_VARIANTS.values()), "".join(k * len(v[2:]) for k, v in CASE_VARIANTS.items())))
    return F.when(F.length(word) <= max(map(len, ABBREVIATIONS)), F.try_element_at(table, capitals))


def clean_text(text: Column) -> Column:
    """Expand abbreviations, drop other characters, collapse spaces, lower-case; null gives ''.

    Characters to drop are no word characters, so turning them to spaces first
    moves no word boundary, and one pass does it together with the spaces.
    """
    kept = F.regexp_replace(text, rf"[^{WORD}\-.,()]+", " ")

    def expanded(of: Column) -> Column:
        # Words and what is between them, in turn; each is looked up once.
        parts = F.transform(F.split(of, _EDGES), lambda part: F.coalesce(_meaning(part), part))
        # Most texts hold no abbreviation and are not taken apart.
        return F.when(F.concat(F.lit(" "), of).rlike(_whole_word(list(ABBREVIATIONS))), F.array_join(parts, "")).otherwise(of)

    # By way of a list of one, so that the kept text is made once.
    return F.coalesce(F.lower(F.trim(F.transform(F.array(kept), expanded)[0])), F.lit(""))


def combined_text(drugname: Column, route: Column, prod_ai: Column, reactions: Column) -> Column:
    """Narrative before cleaning: null parts are left out, empty ones stay."""
    return F.concat_ws(
        ". ",
        F.concat(F.lit("Drug: "), drugname),
        F.concat(F.lit("Route: "), route),
        F.concat(F.lit("Active ingredient: "), prod_ai),
        F.concat(F.lit("Reactions: "), reactions),
    )


def narrative(drugname: Column, route: Column, prod_ai: Column, reactions: Column) -> Column:
    """Cleaned narrative with a stand-in for cases that have none."""
    # A replacement names the cleaned text once; a condition would compute it twice.
    return F.regexp_replace(clean_text(combined_text(drugname, route, prod_ai, reactions)), "^$", EMPTY_NARRATIVE)


def words(text: Column) -> Column:
    """Words of a cleaned text."""
    return F.array_remove(F.split(text, " "), "")


def tokens(text: Column, limit: int = 256) -> Column:
    """Leading words, at most ``limit``: the input length of the text model."""
    return F.slice(words(text), 1, limit)


def risky_reaction(reactions: Column) -> Column:
    """True when a reaction of the risk rule occurs."""
    return reactions.rlike(RISK_REACTIONS)


def expand_frequency(dose_freq: Column) -> Column:
    """Dose frequency codes in the wording of score requests (``QD`` -> ``once daily``)."""
    mapping = [F.lit(x) for pair in ABBREVIATIONS.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*mapping), F.upper(dose_freq)), dose_freq)
