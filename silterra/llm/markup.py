"""A page's pieces in time linear in its length, whatever is left unclosed in it.

A piece is a comment, an element whose content isn't shown, a tag, a declaration, a run of text or a single ``<``. A closing mark that doesn't come
again is remembered as such, so its opening marks beyond are not tried.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

HIDDEN = ("script", "style", "noscript", "template")
_CLOSED = re.compile(r"</(script|style|noscript|template)\s*>", re.I)


@functools.cache
def _pattern(comments: bool, tags: bool, hidden: tuple[str, ...]) -> re.Pattern[str]:
    """Groups: 1 a hidden element's name, 2 a tag's name, 3 its attributes, 4 text. Beyond the last ``>`` all is text."""
    if not tags:
        return re.compile(r"(?!)()()()|(.+)", re.S)
    parts = [r"<!--.*?-->"] if comments else []
    parts.append(rf"<({'|'.join(hidden)})\b.*?</\1\s*>" if hidden else r"(?!)()")
    return re.compile("|".join([*parts, r"<(/?[a-zA-Z][^\s>/]*+)([^>]*+)>", r"<[!?][^>]*+>", r"([^<]++|<)"]), re.S | re.I)


def pieces(page: str, hidden: tuple[str, ...] = HIDDEN) -> Iterator[re.Match[str]]:
    """Matches that make up the page: see ``_pattern`` for their groups; ``lastindex`` is 4 for text, 3 for a tag."""
    last = {m[1].lower(): m.start() for m in _CLOSED.finditer(page)}
    comment, tag = page.rfind("-->"), page.rfind(">")
    at = 0
    while at < len(page):
        alive = tuple(name for name in hidden if last.get(name, -1) >= at)
        cut = min([x for x in (comment, tag, *(last[name] for name in alive)) if x >= at], default=len(page))
        for m in _pattern(comment >= at, tag >= at, alive).finditer(page, at):
            if m.start() > cut:
                break
            yield m
            at = m.end()
        else:
            return
