"""Engine settings and their JSON file."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields
from pathlib import Path

#: Headers that may carry the address of the real client, most trusted first.
CLIENT_IP_PRIORITY = ("CF-Connecting-IP", "True-Client-IP", "X-Forwarded-For", "X-Real-IP", "cnd-src-ip", "c-ip")


@dataclass(frozen=True)
class EngineSettings:
    page_size: int = 200
    index_batch_size: int = 2000
    retention_days: int | None = None
    max_search_results: int = 10_000
    realtime_refresh_seconds: int = 5
    slow_request_threshold_ms: int = 1000
    display_time_zone: str = "UTC"
    include_subfolders: bool = False
    client_ip_priority: tuple[str, ...] = CLIENT_IP_PRIORITY

    @classmethod
    def load(cls, path: str | Path) -> EngineSettings:
        """Settings from ``path``; defaults for whatever is missing, and for all of it if the file cannot be read."""
        try:
            found = json.loads(Path(path).read_text(encoding="utf-8"))
            known = {f.name for f in fields(cls)}
            kept = {k: tuple(v) if isinstance(v, list) else v for k, v in found.items() if k in known}
            return cls(**kept)
        except (OSError, ValueError, TypeError, AttributeError):
            return cls()

    def save(self, path: str | Path) -> None:
        """Write atomically: readers see the old file or the new one."""
        path = Path(path)
        path.parent.mkdir(parents=True, exist_ok=True)
        temp = path.with_name(path.name + ".tmp")
        temp.write_text(json.dumps(asdict(self), indent=2), encoding="utf-8")
        os.replace(temp, path)

    @property
    def bounded_max_results(self) -> int:
        return min(max(self.max_search_results, 100), 100_000)

    @property
    def bounded_batch_size(self) -> int:
        return min(max(self.index_batch_size, 100), 10_000)
