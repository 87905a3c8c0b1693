"""Noise tests and the assembled text of a comment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bodies that carry no text, and the headings of the assembled text.
NOISE = ("", "[deleted]", "[removed]")
TITLE_HEAD = "Post Title:\n\n"
BODY_HEAD = "\n\nPost Body:\n\n"
COMMENT_HEAD = "\n\nComment Body:\n\n"


def is_noise(column: str) -> Column:
    """Null for a null body, which a filter then drops."""
    return F.col(column).isin(*NOISE)


def text_content(title: str = "post_title", body: str = "post_body", comment: str = "comment_body") -> Column:
    """Post title, post body and comment under fixed headings; a missing post field reads as empty."""
    return F.concat(
        F.lit(TITLE_HEAD), F.coalesce(F.col(title), F.lit("")),
        F.lit(BODY_HEAD), F.coalesce(F.col(body), F.lit("")),
        F.lit(COMMENT_HEAD), F.col(comment),
    )
