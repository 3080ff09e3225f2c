"""Own posts of a compilation page, from the rows of its table, as column expressions.

A page gives one entry a table row: ``own`` (a row of the table itself, not of one inside it),
``cells``, ``footer``, ``turn`` (the row's place, from 1, within a run of two-cell rows; 0 outside),
``lines`` (the second cell, a line a piece), ``words`` (its paragraphs, or all of it, joined) and ``href``
(the row's first link). Which rows are posts, whose they are and what is left of them follows here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslake.functions import text as T

ROW = "struct<own:boolean,cells:int,footer:boolean,turn:int,lines:string,words:string,href:string>"


def is_flat(rows: Column) -> Column:
    """Whether each of the table's own rows, a footer apart, is one post: two cells, the time and the post."""
    return F.forall(rows, lambda r: ~r["own"] | r["footer"] | (r["cells"] == 2))


def flat_posts(rows: Column) -> Column:
    """Posts of a table of (time, post) rows: no reposts, no bare links."""
    bodies = F.transform(F.filter(rows, lambda r: r["cells"] == 2), lambda r: T.post_body(r["lines"]))
    kept = F.filter(bodies, lambda b: (b != "") & ~T.is_repost(b) & T.is_substantive(b))
    return F.filter(F.transform(kept, T.clean_post), lambda p: p != "")


def paired_posts(rows: Column) -> Column:
    """Posts of a table in which the row behind a post's holds its link.

    In a run of two-cell rows every other one is a post, the first of them to begin with; the rows between and
    the one behind the run are links. A post is own unless its link names another handle.
    """
    own = F.filter(rows, lambda r: r["own"])
    linked = F.transform(own, lambda r, k: F.struct(r.alias("row"), F.get(own, k + 1)["href"].alias("link")))
    posts = F.filter(linked, lambda p: (p["row"]["turn"] % 2 == 1) & (p["row"]["words"] != "") & (T.permalink_handle(p["link"]) == T.OWN_HANDLE))
    return F.filter(F.transform(posts, lambda p: T.clean_post(p["row"]["words"])), lambda p: F.length(p) >= 3)


def own_posts(rows: Column | str) -> Column:
    """The own posts of a page in order, blank lines between them; null without any."""
    r = F.col(rows) if isinstance(rows, str) else rows
    found = F.when(is_flat(r), flat_posts(r)).otherwise(paired_posts(r))
    return F.when(F.size(found) > 0, F.array_join(found, "\n\n"))
