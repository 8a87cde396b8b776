"""What a stream's progress says of its batches: the counts of the cascade's stages, and how old the newest scene is."""

from __future__ import annotations

import datetime as dt

from pyspark.sql.streaming import StreamingQueryListener


class StageListener(StreamingQueryListener):
    """Keeps, for the streams whose rows are ``pixels.counted`` under ``name``, the counts of their last ``keep`` batches, with the
    age of the newest row at the time of the batch and whether it is beyond ``limit_minutes``. Add it to the session's
    ``streams``; batches without rows say nothing."""

    def __init__(self, name: str = "stages", limit_minutes: float = 20.0, keep: int = 1000) -> None:
        self.name, self.limit, self.keep = name, limit_minutes, keep
        self.batches: list[dict] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is None or not row["seeds"]:
            return
        at = dt.datetime.fromisoformat(event.progress.timestamp.replace("Z", "+00:00"))
        counts = row.asDict()
        newest = counts.pop("newest_micros")
        age = None if newest is None else (at.timestamp() - newest / 1e6) / 60
        counts |= {
            "batch": event.progress.batchId, "age_minutes": None if age is None else round(age, 1),
            "stale": age is not None and age > self.limit
        }
        self.batches = [*self.batches, counts][-self.keep :]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
