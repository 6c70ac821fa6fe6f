"""Download of a table that a server hands out in pages, with any client that can GET."""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import urlsplit

#: Statuses that are tried again.
RETRIED = (429, 500, 502, 503, 504)


@dataclass(frozen=True)
class Page:
    """What a client returns: status, headers in lower case, body."""

    status: int
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes = b""


def next_link(page: Page, host: str) -> str | None:
    """The one ``rel="next"`` link, which must stay on the host."""
    found = re.findall(r'<([^>]+)>\s*;\s*rel="next"', page.headers.get("link", ""))
    if len(found) > 1:
        raise ValueError("more than one next page")
    if found and urlsplit(found[0]).netloc != host:
        raise ValueError("the next page is on another host")
    return found[0] if found else None


def delay(attempt: int, first: float, most: float, page: Page | None) -> float:
    """Seconds before the attempt-th retry: doubling, at least what the server asks, at most ``most``."""
    asked = page.headers.get("retry-after", "") if page else ""
    return min(most, max(first * 2 ** (attempt - 1), float(asked) if asked.isdigit() else 0.0))


def fetch(get: Callable[[str], Page], url: str, sleep: Callable[[float], None], tries: int = 5, first: float = 1.0, most: float = 60.0) -> Page:
    for attempt in range(1, tries + 1):
        page = None
        try:
            page = get(url)
        except OSError:
            if attempt == tries:
                raise
        if page is not None and page.status == 200:
            return page
        if attempt == tries or page is not None and page.status not in RETRIED:
            raise ValueError(f"{url}: status {page.status if page else 'none'}")
        sleep(delay(attempt, first, most, page))
    raise ValueError(f"{url}: no answer")


def normalized(body: bytes, columns: list[str]) -> list[str]:
    """Data lines of a page with exactly the declared header and as many cells in each line."""
    lines = body.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n").rstrip("\n").split("\n")
    if lines[0].split("\t") != columns:
        raise ValueError("the header differs")
    if any(line.count("\t") != len(columns) - 1 for line in lines[1:]):
        raise ValueError("a line has another number of cells")
    return lines[1:]


def download(get: Callable[[str], Page], url: str, columns: list[str], sleep: Callable[[float], None] = lambda s: None) -> tuple[bytes, list[int]]:
    """All pages under one header as a gzip file that depends on nothing else, and the rows of each page."""
    host, seen, bodies, lines, counts, total = urlsplit(url).netloc, set(), set(), [], [], None
    while url:
        if url in seen:
            raise ValueError("the pages go in a circle")
        seen.add(url)
        page = fetch(get, url, sleep)
        digest = hashlib.sha256(page.body).digest()
        if digest in bodies:
            raise ValueError("two pages are equal")
        bodies.add(digest)
        stated = page.headers.get("x-total-results")
        if total is not None and stated != total:
            raise ValueError("the stated total changed")
        total = stated
        own = normalized(page.body, columns)
        lines += own
        counts.append(len(own))
        url = next_link(page, host)
    if total is not None and int(total) != len(lines):
        raise ValueError("rows are missing")
    text = "\n".join(["\t".join(columns), *lines]) + "\n"
    return gzip.compress(text.encode(), 9, mtime=0), counts
