"""Archive pages to listing rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from zeitton.functions.dates import day_text
from zeitton.functions.html import (
    attribute,
    attribute_pattern,
    depths,
    from_position,
    marks,
    open_position,
    opens,
    tag_name,
    text_after,
    tokens,
    visible_text,
    without_hidden,
)
from zeitton.functions.text import bind, once

# The markup of an archive page.
HEADLINE_CLASS = "archive__headline"
CONTENT_ID = "content"
WRAPPER_CLASS = "copytext-element-wrapper__vertical-only"
LINK_CLASS = "teaser-right__link"
TEASER_FIELDS = {
    "headline": ("span", "teaser-right__headline"),
    "short_headline": ("span", "teaser-right__labeltopline"),
    "short_text": ("p", "teaser-right__shorttext"),
    "date": ("div", "teaser-right__date"),
}
SKIPPED_WRAPPERS = 2
TEASER_CLASSES = "teaser-right__"  # what all classes of a teaser have in common

TEASERS = "array<struct<headline:string,short_headline:string,short_text:string,date:string,link:string>>"


def _class(name: str) -> str:
    return attribute_pattern("class", name, token=True)


def page_tokens(html: Column) -> Column:
    return tokens(without_hidden(html))


def monthly_summary(page: Column) -> Column:
    """True when the archive headline is there and does not begin with a digit."""

    def text_of(rest: Column) -> Column:
        name = F.lower(F.regexp_extract(F.get(rest, 0), "^[A-Za-z0-9]+", 0))
        end = bind(
            F.concat(F.lit("/"), name),
            lambda close: F.array_position(F.transform(rest, lambda t: F.lower(t).startswith(close)), F.lit(True)),
        )
        return visible_text(F.slice(rest, F.lit(1), F.greatest(end.cast("int") - 1, F.lit(1))))

    return bind(
        open_position(page, "[a-z][a-z0-9]*", _class(HEADLINE_CLASS), HEADLINE_CLASS),
        lambda at: F.when(
            at > 0,
            bind(
                bind(from_position(page, at), text_of),
                lambda text: (text != "") & ~text.rlike(r"(?U)^\d"),
            ),
        ).otherwise(False),
    )


def _content(page: Column) -> Column:
    """Tokens from the content element on, with the marks and depths of their divs; null when absent."""
    rest = bind(
        open_position(page, "div", attribute_pattern("id", CONTENT_ID), CONTENT_ID),
        lambda at: F.when(at > 0, from_position(page, at)),
    )
    marked = bind(rest, lambda r: F.struct(r.alias("tokens"), marks(r, "div").alias("marks")))
    return bind(
        marked,
        lambda c: F.struct(
            c["tokens"].alias("tokens"), c["marks"].alias("marks"), depths(c["marks"]).alias("depths")
        ),
    )


def _elements(content: Column) -> Column:
    """Opening and closing token of every div, in page order; ``end`` is null for one never closed.

    An element's marks share its nesting level, where opening and closing ones take turns. Sorted by
    level and place, each opening mark has its closing one right behind it.
    """

    def mark(at: Column, i: Column) -> Column:
        depth = F.get(content["depths"], i)
        return F.struct(F.when(at > 0, depth).otherwise(depth + 1).alias("level"), F.abs(at).alias("at"), (at > 0).alias("open"))

    def paired(ordered: Column) -> Column:
        def pair(m: Column, k: Column) -> Column:
            following = F.get(ordered, k + 1)
            closes = (following["level"] == m["level"]) & ~following["open"]
            return F.when(m["open"], F.struct(m["at"].alias("at"), F.when(closes, following["at"]).alias("end")))

        return F.sort_array(F.filter(F.transform(ordered, pair), lambda p: p.isNotNull()))

    return bind(F.sort_array(F.transform(content["marks"], mark)), paired)


def _wrappers(content: Column) -> Column:
    """Teaser wrappers inside the content element, in page order, the skipped ones left out."""
    lookahead = _class(WRAPPER_CLASS)

    def chosen(elements: Column) -> Column:
        end = F.get(elements, 0)["end"]  # the first element is the content itself
        inside = F.filter(
            elements,
            lambda e, i: (i > 0) & (end.isNull() | (e["at"] < end)) & F.get(content["tokens"], e["at"] - 1).contains(WRAPPER_CLASS) & opens(F.get(content["tokens"], e["at"] - 1), "div", lookahead),
        )
        return bind(inside, lambda f: F.slice(f, F.lit(SKIPPED_WRAPPERS + 1), F.greatest(F.size(f), F.lit(1))))

    return bind(_elements(content), chosen)


def _teaser(page: Column, first: Column, count: Column) -> Column:
    """The five fields of the teaser in these tokens of a page, collected by one pass over them.

    Per field the state holds how deep the pass is inside the field's element (0 before it, -1 behind it) and its
    text so far, so elements may nest in any way. Each token is looked at once: its tag name, its
    text, and, where it names a class of a teaser, which field it opens.
    """
    tags = {name: tag for name, (tag, _) in TEASER_FIELDS.items()}

    def looked_at(token: Column) -> Column:
        of_teaser = token.contains(TEASER_CLASSES)
        return F.struct(
            token.alias("token"),
            of_teaser.alias("opens"),
            tag_name(token).alias("name"),
            text_after(token).alias("text"),
            (token.contains(LINK_CLASS) & opens(token, "a", _class(LINK_CLASS))).alias("link"),
            *(
                (token.contains(css) & opens(token, tag, _class(css))).alias(name)
                for name, (tag, css) in TEASER_FIELDS.items()
            ),
        )

    def step(state: Column, t: Column) -> Column:
        def depth(name: str) -> Column:
            change = F.when(t["name"] == tags[name], 1).when(t["name"] == "/" + tags[name], -1).otherwise(0)
            inside = F.when(state[f"{name}_depth"] + change == 0, -1).otherwise(state[f"{name}_depth"] + change)
            return F.when(state[f"{name}_depth"] > 0, inside).when(state[f"{name}_depth"] == 0, t[name].cast("int")).otherwise(-1)

        def gone_on(depths: Column) -> Column:
            def text(name: str) -> Column:
                return F.when(depths[name] > 0, F.concat(state[name], t["text"])).otherwise(state[name])

            return F.struct(
                F.when(state["link"].isNull() & t["link"], t["token"]).otherwise(state["link"]).alias("link"),
                *(depths[name].alias(f"{name}_depth") for name in tags),
                *(text(name).alias(name) for name in tags),
            )

        # Most tokens are met outside the fields and open none of them.
        untouched = ~t["opens"] & (F.greatest(*(state[f"{name}_depth"] for name in tags)) <= 0)
        return F.when(untouched, state).otherwise(bind(F.struct(*(depth(name).alias(name) for name in tags)), gone_on))

    start = F.struct(
        F.lit(None).cast("string").alias("link"),
        *(F.lit(0).alias(f"{name}_depth") for name in tags),
        *(F.lit("").alias(name) for name in tags),
    )
    return F.aggregate(
        F.transform(F.slice(page, first, count), looked_at), start, step,
        lambda end: F.struct(
            *(end[name].alias(name) for name in tags),
            F.coalesce(attribute(end["link"], "href"), F.lit("")).alias("link"),
        ),
    )


def page_facts(pages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """All that a collection run needs of archive pages ``(day, page, html)``, from one pass over the HTML.

    ``day, page``, the columns named in ``keep``, ``error`` (no text), ``monthly_summary``, ``n_links``, and ``teasers``, an array with the
    fields of every teaser in page order. The pass is made once, whatever is done with the columns later.
    """

    def facts(page: Column) -> Column:
        content = _content(page)
        teasers = bind(
            content,
            lambda c: F.transform(
                _wrappers(c), lambda e: _teaser(c["tokens"], e["at"], F.coalesce(e["end"] - e["at"], F.size(c["tokens"])))
            ),
        )
        return F.struct(
            F.coalesce(teasers, F.array().cast(TEASERS)).alias("teasers"), monthly_summary(page).alias("monthly_summary")
        )

    own = dict.fromkeys(["day", "page", *keep, *(c for c in ("start_page",) if c in pages.columns)])
    page = page_tokens(F.coalesce(F.col("html"), F.lit("")))
    held = once(pages.select(*own, "html"), "__f", bind(page, facts))
    return held.select(
        *own, F.col("html").isNull().alias("error"), "__f.monthly_summary", F.size("__f.teasers").alias("n_links"), "__f.teasers"
    )


def page_status(pages: DataFrame) -> DataFrame:
    """(day, page) with number of teasers, summary flag and whether the page is missing its text."""
    page = page_tokens(F.coalesce(F.col("html"), F.lit("")))
    count = bind(
        page,
        lambda p: F.struct(
            bind(_content(p), lambda c: F.size(_wrappers(c))).alias("n"), monthly_summary(p).alias("monthly_summary")
        ),
    )
    own = ["day", "page", *(c for c in ("start_page",) if c in pages.columns)]
    held = once(pages.select(*own, "html"), "__f", count)
    n_links = F.greatest(F.coalesce("__f.n", F.lit(0)), F.lit(0))
    return held.select(*own, n_links.alias("n_links"), "__f.monthly_summary", F.col("html").isNull().alias("error"))


def listing_rows(facts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Listing rows from ``page_facts``: one per teaser, missing fields empty, the columns named in ``keep`` first."""
    teasers = facts.select(*dict.fromkeys(["day", "page", *keep]), F.posexplode("teasers").alias("position", "t"))
    return teasers.select(
        *keep,
        day_text(F.col("day")).alias("date_api"),
        F.col("page").alias("page_api"),
        F.when(F.col("t.date") != "", F.col("t.date")).otherwise(day_text(F.col("day"))).alias("date"),
        "t.headline",
        "t.short_headline",
        "t.short_text",
        "t.link",
        "position",
    )


def extract_teasers(pages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Listing rows of archive pages ``(day, page, html)``. One scan without a shuffle."""
    return listing_rows(page_facts(pages, keep), keep)


def relative_links(df: DataFrame, link: str = "link") -> DataFrame:
    return df.where(~F.col(link).startswith("http"))


def article_url(link: Column, base: str) -> Column:
    return F.concat(F.lit(base.rstrip("/")), link)


def archive_url(day: Column, page: Column, base: str) -> Column:
    return F.format_string(f"{base.rstrip('/')}/archiv?datum=%s&pageIndex=%d", day_text(day), page)
