"""Private copies of databases that others may be writing to."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path


class SourceChanged(Exception):
    """A file kept changing while it was copied."""


@contextmanager
def private_copy(database: str, attempts: int = 3) -> Iterator[str]:
    """A copy of a database and its write-ahead log that no one else writes to; the originals are never opened by the database library.

    Both files are hashed before and after they are copied; if they change each time, SourceChanged is raised.
    """
    pair = [Path(database), Path(f"{database}-wal")]

    def prints() -> list[str | None]:
        return [hashlib.sha256(p.read_bytes()).hexdigest() if p.exists() else None for p in pair]

    with tempfile.TemporaryDirectory(prefix="threadlake-") as folder:
        copies = [Path(folder, "copy.db"), Path(folder, "copy.db-wal")]
        for _ in range(attempts):
            before = prints()
            for source, target in zip(pair, copies):
                target.unlink(missing_ok=True)
                if source.exists():
                    target.write_bytes(source.read_bytes())
            if before == prints() and before == [hashlib.sha256(p.read_bytes()).hexdigest() if p.exists() else None for p in copies]:
                break
        else:
            raise SourceChanged(database)
        yield str(copies[0])
