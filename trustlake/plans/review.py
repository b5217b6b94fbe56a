"""A worked action: a song goes to review, with a document in an outbox, if anybody played it."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import functions as F

from ..operators.checks import Evidence, Verdict
from ..operators.gate import Precondition
from ..sources.lake import Reader
from ..sources.publish import PublishTarget, publish_bytes
from .actions import Action, action
from .usage import USAGE


def has_plays(song_id: int) -> Precondition:
    def evaluate(reader: Reader) -> Evidence:
        n = reader.scan(USAGE).where(F.col("song_id") == song_id).count()
        return Evidence(f"song {song_id} has plays", Verdict.PASS if n else Verdict.FAIL, {"plays": n})

    return Precondition(f"song {song_id} has plays", evaluate)


def flag_song_for_review(song_id: int, outbox: PublishTarget) -> Action:
    """Approval is asked for; the document is written once, whoever asks again."""

    @action("flag_song_for_review", preconditions=[has_plays(song_id)])
    def effect(payload: dict[str, Any]) -> None:
        body = json.dumps({"song_id": song_id, **payload}, sort_keys=True).encode()
        publish_bytes(outbox, f"reviews/song-{song_id}.json", body, idempotent=True)

    return effect
