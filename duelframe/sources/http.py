"""Pages by polite GET: the fetch functions that paged sources take."""

from __future__ import annotations

import functools
import time
import urllib.request

#: Seconds between two requests of a process, at least.
PAUSE = 1.0
_last = [0.0]


def get(url: str, headers: dict[str, str] | None = None, timeout: float = 30.0, pause: float = PAUSE) -> str:
    """A page's text. Requests of one process keep a pause between them; what goes wrong is an OSError, which paged.patient tries again."""
    time.sleep(max(0.0, _last[0] + pause - time.monotonic()))
    _last[0] = time.monotonic()
    request = urllib.request.Request(url, headers={"Accept": "application/json", "User-Agent": "duelframe"} | (headers or {}))
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.read().decode(answer.headers.get_content_charset() or "utf-8")


def pages(template: str, **options):
    """A function (offset, limit) -> body that fills both into a URL; bind it to a name in a module and give that to a paged source."""
    return functools.partial(_page, template, options)


def _page(template: str, options: dict, offset: int, limit: int) -> str:
    return get(template.format(offset=offset, limit=limit), **options)
