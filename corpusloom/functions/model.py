"""The surface to external models: retries, status mapping, discovery. Used inside tasks; no network is needed to import it."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Attempts and seconds of back-off for each attempt made.
ATTEMPTS, BACKOFF = 3, 2.0


class Transient(Exception):
    """A timeout or a broken connection; worth another attempt."""


class ModelMissing(ValueError):
    """The server does not have the model."""


def with_retry(call: Callable[[], object], attempts: int = ATTEMPTS, backoff: float = BACKOFF, sleep: Callable[[float], None] = time.sleep) -> object:
    """The call's result; transient errors are tried again after growing pauses, others are raised at once."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except Transient:
            if n == attempts:
                raise
            sleep(backoff * n)
    raise AssertionError


class TimedOut(Transient):
    """A call that did not come back in time."""


def with_timeout(call: Callable[[], object], seconds: float) -> object:
    """The call's result, or ``TimedOut`` once the time is up; the call is left behind in a thread of its own."""
    box: list = []

    def run() -> None:
        try:
            box.append((True, call()))
        except BaseException as e:  # handed to the caller
            box.append((False, e))

    t = threading.Thread(target=run, daemon=True)
    t.start()
    t.join(seconds)
    if not box:
        raise TimedOut(f"no answer in {seconds} s")
    ok, value = box[0]
    if ok:
        return value
    raise value


def check_status(status: int, detail: str, model: str) -> None:
    if status == 404:
        raise ModelMissing(f"model {model} not found")
    if status >= 400:
        raise RuntimeError(f"status {status}: {detail}")


def find_models(wanted: list[str], have: list[str]) -> dict[str, bool]:
    """Which models a server has, by exact name or as ``name:tag``."""
    return {w: any(m == w or m.startswith(w + ":") for m in have) for w in wanted}


def ensure_models(wanted: list[str], have: list[str]) -> None:
    missing = [w for w, ok in find_models(wanted, have).items() if not ok]
    if missing:
        raise ModelMissing("not served: " + ", ".join(missing))


def generate(df: DataFrame, prompt: str, open_client: Callable[[], Callable[[str], str]], keep: list[str], timeout: float | None = None) -> DataFrame:
    """``keep``, answer, error: one client a task, closed at its end if it can be; a failed prompt has an error and no answer.

    With a ``timeout`` each attempt has that many seconds.
    """
    src = df.select(*keep, F.col(prompt).alias("_p"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "_p")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = open_client()
        try:
            for p in batches:
                out, err = [], []
                for x in p["_p"]:
                    try:
                        t = with_retry(lambda x=x: client(x) if timeout is None else with_timeout(lambda: client(x), timeout))
                        if not str(t).strip():
                            raise ValueError("empty answer")
                        out.append(t)
                        err.append(None)
                    except Exception as e:
                        out.append(None)
                        err.append(f"{type(e).__name__}: {e}")
                yield p.drop(columns="_p").assign(answer=out, error=err)
        finally:
            getattr(client, "close", lambda: None)()

    return src.mapInPandas(run, kinds + ", answer string, error string")
