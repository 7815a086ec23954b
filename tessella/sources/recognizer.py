"""Recognition by a model that runs on the executors: pictures in, checked rows out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

FACES = "key string, n int, x double, y double, w double, h double, score double, embedding array<float>, error string"


def checked(reply: dict, width: float, height: float, length: int) -> list[dict]:
    """A model's reply with pixel boxes, as rows with fractions held to [0, 1]. A box that is not finite or empty, or an embedding of
    another length, spoils the whole reply (ValueError)."""
    rows = []
    for i, f in enumerate(reply.get("faces", [])):
        x, y, w, h = (float(v) for v in f["box"])
        if not all(abs(v) < float("inf") for v in (x, y, w, h)) or w <= 0 or h <= 0 or width <= 0 or height <= 0:
            raise ValueError("a box that is none")
        if len(f["embedding"]) != length:
            raise ValueError("an embedding of another length")
        left, top, right, bottom = (min(max(v, 0.0), 1.0) for v in (x / width, y / height, (x + w) / width, (y + h) / height))
        if right <= left or bottom <= top:
            raise ValueError("a box outside the picture")
        rows.append({"n": i, "x": left, "y": top, "w": right - left, "h": bottom - top, "score": float(f.get("score", 0.0)), "embedding": [float(v) for v in f["embedding"]]})
    return rows


def recognize(pictures: DataFrame, make_model: Callable[[], Callable[[bytes], dict]], length: int, tries: int = 2, most_failures: int = 5) -> DataFrame:
    """FACES of pictures(key, content, width, height). make_model runs once a task. A picture that fails `tries` times is a row with an
    error; after most_failures of these in a row the model is made anew, so that one that broke does not fail the rest."""

    def run(frames):
        import pandas as pd

        model, failures = make_model(), 0
        for f in frames:
            out = []
            for r in f.itertuples():
                error = None
                for _ in range(tries):
                    try:
                        out += [{"key": r.key, "error": None} | row for row in checked(model(bytes(r.content)), r.width, r.height, length)]
                        error, failures = None, 0
                        break
                    except Exception as e:  # noqa: BLE001  failures are rows
                        error = str(e)[:200]
                if error is not None:
                    failures += 1
                    out.append({"key": r.key, "n": None, "embedding": None, "error": error})
                    if failures >= most_failures:
                        model, failures = make_model(), 0
            yield pd.DataFrame(out, columns=["key", "n", "x", "y", "w", "h", "score", "embedding", "error"]).astype({"key": object, "error": object, "n": "Int32"})

    return pictures.select("key", "content", "width", "height").mapInPandas(run, FACES)
