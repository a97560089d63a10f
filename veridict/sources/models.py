"""External models behind one seam: prompts in, replies out. By default replies come from a table."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

RETRIED = {408, 429, *range(500, 600)}


class ModelError(RuntimeError):
    """A call that is not to be tried again, or that failed too often."""


def read_env(path: str) -> None:
    """``NAME=value`` lines into the environment; what is set already stays."""
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        name, _, value = line.strip().partition("=")
        if value and not name.startswith("#"):
            os.environ.setdefault(name.strip(), value.strip().strip("'\""))


def read_config(path: str) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def http_model(url: str, model: str, key_name: str = "", retries: int = 3, timeout: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """A chat endpoint as a function; waits 1, 2, 4 ... seconds between tries of what may pass."""

    def call(prompt: str) -> str:
        body = json.dumps({"model": model, "temperature": 0, "messages": [{"role": "user", "content": prompt}]}).encode()
        headers = {"Content-Type": "application/json"}
        if key_name:
            headers["Authorization"] = f"Bearer {os.environ[key_name]}"
        for n in range(retries + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as reply:
                    choice = json.load(reply)["choices"][0]
                if choice.get("finish_reason") == "length":
                    raise ModelError("the reply was cut off at the token limit")
                return choice["message"]["content"]
            except urllib.error.HTTPError as e:
                if e.code not in RETRIED or n == retries:
                    raise ModelError(f"HTTP {e.code}") from e
            except (urllib.error.URLError, TimeoutError) as e:
                if n == retries:
                    raise ModelError(str(e)) from e
            sleep(2.0**n)
        raise ModelError("no try was made")

    return call


def ask(prompts: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """``prompts(instance_id, prompt)`` with reply and seconds; calls run in the partitions' workers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for prompt in batch["prompt"]:
                began = time.perf_counter()
                try:
                    reply = model(prompt)
                except ModelError:
                    reply = None
                rows.append((reply, time.perf_counter() - began))
            yield batch[["instance_id"]].assign(reply=[r for r, _ in rows], runtime_seconds=[s for _, s in rows])

    kind = prompts.schema["instance_id"].dataType.simpleString()
    return prompts.mapInPandas(run, f"instance_id {kind}, reply string, runtime_seconds double")


def recorded(prompts: DataFrame, replies: DataFrame) -> DataFrame:
    """The default model: ``replies(instance_id, reply)`` looked up."""
    return prompts.select("instance_id").join(replies, "instance_id", "left")
