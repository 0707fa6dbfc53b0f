"""Model calls as a pluggable interface (LLM-1..5, 14): backends, retries, prompts, an offline stand-in."""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from cograph.functions import constants as C


class Model(Protocol):
    """budget: tokens that a prompt may have."""

    budget: int

    def chat(self, system: str, user: str, temperature: float = 0.1) -> str: ...


class RuleModel:
    """Answers from the words of the prompt alone: for tests and runs without a network."""

    budget = 14_000
    signs = re.compile(r"sendTextMessage|getDeviceId|getSubscriberId|DexClassLoader|loadClass|exec\b|openConnection|RISK_LEVEL: HIGH")

    def chat(self, system: str, user: str, temperature: float = 0.1) -> str:
        found = sorted(set(self.signs.findall(user)))
        level = "HIGH" if len(found) > 1 else "MEDIUM" if found else "LOW"
        if "CONSISTENT or INCONSISTENT" in system:
            return "VERDICT: CONSISTENT"
        seen = ", ".join(found) or "none"
        verdict = "MALWARE" if level == "HIGH" else "BENIGN"
        return (
            f"BEHAVIOR: the code under analysis was read as it stands; notable calls are: {seen}.\nAPI: {_api(user)}\n"
            f"RISK_ASSESSMENT: {level}\nRISK_LEVEL: {level}\nCONFIDENCE: {level}\nPREDICTION: {verdict}"
        )


def _api(user: str) -> str:
    m = re.search(r"API: *(\S+)", user)
    return m[1] if m else "unknown"


class ModelError(Exception):
    """A failed call; `status`: the service's code, 0 for the network."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(message or f"status {status}")
        self.status = status


class Retrying:
    """Tries again with the next key: waits after each full round of keys, gives up on what another try cannot mend."""

    #: Rate limit, payment and unavailability rotate keys; refused keys are dropped; anything else ends the call.
    rotate, drop = (429, 402, 503, 0), (401, 403, 404)

    def __init__(self, connect: Callable[[str], Model], keys: list[str], attempts: int = 15, base: float = 1.0, cooldown: float = 5.0, sleep=time.sleep):
        self.connect, self.keys, self.attempts, self.base, self.cooldown, self.sleep = connect, list(keys), attempts, base, cooldown, sleep
        self.budget = C.LEAST_BUDGET

    def chat(self, system: str, user: str, temperature: float = 0.1) -> str:
        keys, at = list(self.keys), 0
        for attempt in range(self.attempts):
            if not keys:
                break
            model = self.connect(keys[at % len(keys)])
            self.budget = model.budget
            try:
                return model.chat(system, user, temperature)
            except ModelError as error:
                if error.status in self.drop:
                    keys.pop(at % len(keys))
                elif error.status in self.rotate:
                    at += 1
                    self.sleep(self.cooldown if at % len(keys) == 0 else self.base * 2 ** min(attempt, 6))
                else:
                    raise
        raise ModelError(429, "no key is left or all attempts are used up")


_REGISTRY: dict[str, Callable[..., Model]] = {"rules": RuleModel}
ALIASES = {"offline": "rules", "stub": "rules"}


def register(name: str, factory: Callable[..., Model], *aliases: str) -> None:
    _REGISTRY[name] = factory
    ALIASES.update(dict.fromkeys(aliases, name))


def create(name: str, **options) -> Model:
    from cograph.plans import backends  # noqa: F401  registers the services

    name = ALIASES.get(name.lower(), name.lower())
    if name not in _REGISTRY:
        raise KeyError(f"no backend {name}; there are {sorted(_REGISTRY)}")
    return _REGISTRY[name](**options)


def keys_from_environment(name: str) -> list[str]:
    """NAME, NAME1 or NAME_1, NAME2, ...: the keys of a service, in order, each once."""
    mine = {int(m[1]): v for k, v in os.environ.items() if (m := re.fullmatch(rf"{re.escape(name)}_?(\d+)", k))}
    found = [os.environ.get(name, ""), *(mine[i] for i in sorted(mine))]
    return list(dict.fromkeys(k.strip() for k in found if k.strip()))


def short_of_budget(model: Model, least: int = 10_000) -> bool:
    """Whether a model's prompts are too small for whole apps, which a run should warn of."""
    return model.budget < least


#: Prompts in our own words. The parsers need the field names in capitals.
TIER1 = ("You review one sliced function. Answer with BEHAVIOR: and RISK_ASSESSMENT: LOW, MEDIUM or HIGH.", "FUNCTION: {function}\nAPI: {api}\n\n{body}")
TIER2 = ("You sum up what an app does with one API. Answer with BEHAVIOR: and RISK_LEVEL: LOW, MEDIUM, HIGH or CRITICAL.", "API: {api} ({api_type})\n\n{summaries}")
TIER3 = ("You decide about an app. Answer with PREDICTION: MALWARE or BENIGN on a line of its own, then why.", "{summaries}")
SINGLE = ("You decide about an app from its sensitive functions. Answer with PREDICTION: and CONFIDENCE: lines, then why.", "Similar functions:\n{context}\n\nFunctions ({count}), APIs: {apis}\n\n{document}")
DIRECT = ("You decide about an app from an extract. Answer with PREDICTION: MALWARE or BENIGN.", "{document}")
VERIFY = ("Say whether a summary is supported by the code: VERDICT: CONSISTENT or INCONSISTENT, then REASON:.", "{body}\n\nSummary:\n{summary}")


def ask(df: DataFrame, model: Model, system: str, prompt: str = "prompt") -> DataFrame:
    """`df` with `response` and `error`: a call that fails leaves an error row, not a failed job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said, errors = [], []
            for text in batch[prompt]:
                try:
                    said.append(model.chat(system, text))
                    errors.append(None)
                except Exception as error:
                    said.append(None)
                    errors.append(str(error))
            yield batch.assign(response=said, error=errors)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, response string, error string")
