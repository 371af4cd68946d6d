"""Tag-level reading of HTML with split, regex and array functions.

A page becomes an array of tokens, cut at every ``<`` that begins a tag: each token is a tag and the text
after it, as in ``span class="x">text``. Other ``<`` are part of the text they stand in. An element is found by its opening token and ends at its own closing
one, which the running count of opening and closing tokens of that name tells. Comments, scripts and
styles are blanked first, so they count neither as text nor as tags.
"""

from __future__ import annotations

import re
from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

from zeitton.functions.text import bind, strip

HIDDEN = r"(?is)<(?:!--.*?-->|script\b.*?</script\s*>|style\b.*?</style\s*>)"
TAG_BEGIN = "[A-Za-z/!?]"
QUOTES = ("\"", "'")
COMMON = ("amp", "lt", "gt", "quot", "nbsp", "apos")
ENTITY = r"^&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);?"


def without_hidden(html: Column) -> Column:
    return bind(F.regexp_replace(html, HIDDEN, "<!>"), brackets_in_values_escaped)


def without_comments(html: Column) -> Column:
    """Comments outside scripts are gone; what looks like one inside a script stays."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|(<script\b.*?</script\s*>)", "$1")


def brackets_in_values_escaped(html: Column) -> Column:
    """``<`` and ``>`` inside quoted values become references, so that a bare one always ends or begins a tag.

    Readers of values and of text decode references, which makes this invisible to them.
    """
    some = "|".join(rf"=\s*{q}[^{q}<>]*[<>][^{q}]*{q}" for q in QUOTES)
    escaped = html
    for q in QUOTES:
        for bracket, name in (("<", "&lt;"), (">", "&gt;")):
            run = f"[^{q}{bracket}]*"  # \G goes on in the value where the last replacement ended
            escaped = F.regexp_replace(escaped, rf"(=\s*{q}{run}|\G(?!\A){run}){bracket}(?=[^{q}]*{q})", f"$1{name}")
    return F.when(html.rlike(some), escaped).otherwise(html)


def tokens(html: Column) -> Column:
    """Tokens of a page; text before the first tag comes as the text of an empty declaration.

    Pages whose every ``<`` begins a tag, which are most, are cut by a literal split.
    """
    page = F.concat(F.lit("!>"), html)
    careful = F.split(page, f"<(?={TAG_BEGIN})")
    return F.when(html.rlike(f"<(?!{TAG_BEGIN})"), careful).otherwise(F.split(page, "<"))


def attribute_pattern(name: str, value: str, token: bool = False) -> str:
    """Lookahead for an attribute with this value; ``token`` matches one of several class names.

    Spaces in ``value`` stand for any run of white space. Quotes may be double, single or left out.
    """
    core = r"\s+".join(re.escape(part) for part in value.split())
    forms = []
    for quote in ('"', "'"):
        left = rf"(?:[^{quote}]*\s)?" if token else r"\s*"
        right = rf"(?:\s[^{quote}]*)?" if token else r"\s*"
        forms.append(f"{quote}{left}{core}{right}{quote}")
    forms.append(rf"{core}(?=[\s>/])")
    return rf"(?=[^>]*?\s{name}\s*=\s*(?:{'|'.join(forms)}))"


def opens(token: Column, tag: str, lookahead: str = "") -> Column:
    """Whether a token opens ``tag`` (a name, or a pattern for names) with these attributes."""
    return token.rlike(rf"(?is)^{tag}(?=[\s>/]){lookahead}")


def open_position(page: Column, tag: str, lookahead: str = "", literal: str = "") -> Column:
    """1-based position of the first such opening token, 0 when there is none.

    All tokens are looked at; where the attribute's value is plain text, ``literal`` spares most of them the pattern.
    """
    return F.array_position(F.transform(page, lambda t: t.contains(literal) & opens(t, tag, lookahead)), F.lit(True)).cast("int")


def from_position(page: Column, at: Column) -> Column:
    return F.slice(page, at, F.size(page))


def marks(page: Column, tag: str) -> Column:
    """1-based positions of the tokens of one tag name, negative where it is closed."""

    def mark(token: Column, i: Column) -> Column:
        place = F.when(token.startswith("/"), -(i + 1)).otherwise(i + 1)
        return F.when(token.rlike(rf"(?i)^/?{tag}[\s>/]"), place)

    return F.filter(F.transform(page, mark), lambda m: m.isNotNull())


def _running_sum(values: Column) -> Column:
    """Running sums of an array; each step copies the array so far, so it suits short ones."""
    return F.aggregate(
        values,
        F.array().cast("array<int>"),
        lambda acc, v: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + v),
    )


def depths(signed: Column, block: int = 64) -> Column:
    """Nesting depth after each mark: running sums within blocks, plus those of the blocks before."""
    steps = F.transform(signed, lambda m: F.signum(m.cast("double")).cast("int"))

    def joined(blocks: Column) -> Column:
        totals = _running_sum(F.transform(blocks, lambda b: F.get(b, F.size(b) - 1)))
        return bind(
            totals,
            lambda t: F.flatten(
                F.transform(
                    blocks,
                    lambda b, i: F.transform(b, lambda v: v + F.coalesce(F.get(t, i - 1), F.lit(0))),
                )
            ),
        )

    def summed(all_steps: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(all_steps), F.lit(1)), F.lit(block))
        blocks = F.transform(starts, lambda at: _running_sum(F.slice(all_steps, at, F.lit(block))))
        return F.when(F.size(all_steps) <= block, _running_sum(all_steps)).otherwise(bind(blocks, joined))

    return bind(steps, summed)


def closed(page: Column, tag: str) -> Column:
    """Tokens of the element that the first token opens; all tokens when it is never closed."""

    def cut(signed: Column) -> Column:
        nested = F.array_position(depths(signed), F.lit(0)).cast("int")
        # With nothing nested the second mark is the closing one.
        which = F.when(F.get(signed, 1) < 0, F.lit(2)).otherwise(nested)
        end = bind(which, lambda w: F.when(w > 0, -F.get(signed, w - 1) - 1).otherwise(F.size(page)))
        return F.slice(page, F.lit(1), end)

    return bind(marks(page, tag), cut)


def element(page: Column, tag: str, lookahead: str = "", literal: str = "") -> Column:
    """Tokens of the first matching element; null when there is none."""
    return bind(
        open_position(page, tag, lookahead, literal),
        lambda at: F.when(at > 0, bind(from_position(page, at), lambda rest: closed(rest, tag))),
    )


def attribute(token: Column, name: str) -> Column:
    """Value of an attribute of an opening token; ``""`` when missing."""
    pattern = rf"(?is)^[^>]*?\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    value = bind(token, lambda t: F.concat(*(F.regexp_extract(t, pattern, i) for i in (1, 2, 3))))
    return bind(value, decode_entities)


def _named_entities() -> Column:
    """Names and their characters; a map is searched from its beginning, so the common names come first."""
    all_names = {**name2codepoint, "apos": 39}
    names = sorted(all_names.items(), key=lambda item: (item[0] not in COMMON, item[0]))
    body = ", ".join(f"'{name}', {code}" for name, code in names)
    return F.expr(f"map({body})")


def _character(code: Column) -> Column:
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def decode_entities(text: Column) -> Column:
    """Named and numeric character references become characters; unknown ones stay as written."""
    named = _named_entities()

    def decode_piece(piece: Column) -> Column:
        whole = F.regexp_extract(piece, ENTITY, 0)

        def replace(name: Column) -> Column:
            code = (
                F.when(name.rlike("^#[xX]"), F.conv(F.substr(name, F.lit(3)), 16, 10).try_cast("int"))
                .when(name.startswith("#"), F.substr(name, F.lit(2)).try_cast("int"))
                .otherwise(F.try_element_at(named, name))
            )
            return F.concat(bind(code, _character), F.substr(piece, F.length(whole) + 1))

        decoded = bind(F.regexp_extract(piece, ENTITY, 1), replace)
        return F.when(piece.startswith("&"), F.coalesce(decoded, piece)).otherwise(piece)

    pieces = F.transform(F.split(text, "(?=&)"), decode_piece)
    return F.when(text.contains("&"), F.array_join(pieces, "")).otherwise(text)


def tag_name(token: Column) -> Column:
    """The tag's name in lower case, with its ``/`` if it closes; told without a pattern."""
    tag = F.translate(F.substring_index(token, ">", 1), "\t\n\r\f", "    ")
    return F.lower(F.rtrim(F.substring_index(tag, " ", 1), F.lit("/")))


def text_after(token: Column) -> Column:
    """The text node behind the tag of a token, decoded and stripped."""
    end = F.instr(token, ">")
    after = F.when(end > 0, F.substr(token, end + 1)).otherwise("")
    return bind(after, lambda t: F.when(t == "", t).otherwise(strip(decode_entities(t))))


def visible_text(page: Column) -> Column:
    """Every text node stripped, joined with nothing."""
    return F.array_join(F.transform(page, text_after), "")


def element_text(page: Column, tag: str, lookahead: str = "", literal: str = "") -> Column:
    """Visible text of the first matching element; ``""`` when there is none."""
    return F.coalesce(visible_text(element(page, tag, lookahead, literal)), F.lit(""))
