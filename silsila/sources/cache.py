"""A read-through cache of fetched bodies: the fetcher is given, so nothing here needs a network."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from pathlib import Path


class NotFound(Exception):
    """The source does not exist; asking again will not help."""


def fetch_cached(key: str, fetch: Callable[[str], str], folder: str, refresh: bool = False, retries: int = 4, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """The cached body of key, else what fetch returns, which is then cached. Failures but NotFound are tried again, waiting twice as long each time."""
    path = Path(folder) / hashlib.sha256(key.encode()).hexdigest()
    if path.exists() and not refresh:
        return path.read_text()
    for attempt in range(retries):
        try:
            body = fetch(key)
            break
        except NotFound:
            raise
        except Exception:
            if attempt == retries - 1:
                raise
            sleep(wait * 2**attempt)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(body)
    return body
