"""Driver-side fetches with retries.  The getter is a parameter, so that nothing here needs a network in tests."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from pathlib import Path

Getter = Callable[[str], tuple[int, bytes]]


def fetch_with_retry(get: Getter, url: str, tries: int = 3, wait: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> bytes | None:
    """The body; waits and tries again when told to slow down (429); None on any other failure."""
    for k in range(tries):
        status, body = get(url)
        if status == 200:
            return body
        if status != 429:
            return None
        if k + 1 < tries:
            sleep(wait)
    return None


def fetch_with_backoff(get: Getter, url: str, tries: int = 5, step: float = 3.0, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """The body, with waits that grow by `step`; an error when all tries fail."""
    last = 0
    for k in range(tries):
        last, body = get(url)
        if last == 200:
            return body
        sleep(step * (k + 1))
    raise RuntimeError(f"{url} failed {tries} times, last with status {last}")


def fetch_cached(get: Getter, url: str, path: Path, **kw) -> Path:
    if not path.exists():
        path.write_bytes(fetch_with_backoff(get, url, **{"step": 2.0, **kw}))
    return path


def widening_listing(fetch: Callable[[date, date], tuple[int, bytes]], today: date, days: int = 7, step: int = 7, most: int = 90) -> bytes | None:
    """The listing of the last `days`; looks back `step` days more until there is a document or `most` is reached."""
    back = days
    while True:
        hits, body = fetch(today - timedelta(days=back), today)
        if hits:
            return body
        if back >= most:
            return None
        back = min(most, back + step)


def all_pages(fetch: Callable[[int], tuple[int, list]], first: int = 1) -> Iterator:
    """Items of all pages until the announced number is reached; fetch(page) gives (announced, items)."""
    seen, page = 0, first
    while True:
        announced, items = fetch(page)
        yield from items
        seen += len(items)
        if seen >= announced or not items:
            return
        page += 1
