"""Backends of `models` (LLM-2..4, SRC-21, SRC-22, WIN-19): hosted and local chat services, and their catalogues.

A service is a record: its address, the form of its requests, its budget and the names of its settings. There are three forms
of requests (chat completions, generated content, a local server's chat), each a few lines over one HTTP call, so another service
is another record. Objects hold settings only and connect when asked, so they travel to the tasks of `models.ask`.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cograph.functions import constants as C
from cograph.plans import models as M


def call(url: str, body: dict | None = None, headers: dict[str, str] | None = None, timeout: float = 600) -> dict:
    """One JSON request: POST with a body, else GET. What fails is a ModelError with the service's code, 0 for the network."""
    data = None if body is None else json.dumps(body).encode()
    request = urllib.request.Request(url, data, {"Content-Type": "application/json", **(headers or {})})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as error:
        raise M.ModelError(error.code, error.read(500).decode(errors="replace")) from error
    except (urllib.error.URLError, TimeoutError, ConnectionError) as error:
        raise M.ModelError(0, str(error)) from error
    except ValueError as error:
        raise M.ModelError(502, f"not JSON: {error}") from error


@dataclass(frozen=True)
class Service:
    """keys: the name of the key's setting (None: no key is needed); model: the setting and the default of the model's name."""

    name: str
    address: str
    form: str
    keys: str | None
    model: tuple[str, str]
    budget: int
    aliases: tuple[str, ...] = ()
    address_setting: str | None = None


#: The services' public addresses, settings and default models.
SERVICES = {
    s.name: s
    for s in (
        Service("openai", "https://api.openai.com/v1", "completions", "OPENAI_API_KEY", ("OPENAI_MODEL", "gpt-4o-mini"), C.BUDGETS["openai"], address_setting="OPENAI_BASE_URL"),
        Service("openrouter", "https://openrouter.ai/api/v1", "completions", "OPENROUTER_API_KEY", ("OPENROUTER_MODEL", "nvidia/nemotron-3-ultra-550b-a55b:free"), C.BUDGETS["openrouter"], ("nemotron",)),
        Service("nvidia", "https://integrate.api.nvidia.com/v1", "completions", "NVIDIA_API_KEY", ("NVIDIA_MODEL", "nvidia/llama-3.1-nemotron-70b-instruct"), C.BUDGETS["nvidia"]),
        Service("groq", "https://api.groq.com/openai/v1", "completions", "GROQ_API_KEY", ("GROQ_MODEL", "openai/gpt-oss-120b"), C.BUDGETS["groq"]),
        Service("gemini", "https://generativelanguage.googleapis.com/v1beta", "content", "GEMINI_API_KEY", ("GEMINI_MODEL", "gemini-3.5-flash"), C.BUDGETS["gemini"]),
        Service("ollama", "http://localhost:11434", "local", None, ("OLLAMA_MODEL", ""), 0, address_setting="OLLAMA_HOST"),
    )
}


@dataclass(frozen=True)
class Chat:
    """One model of one service with one key."""

    service: Service
    model: str
    key: str = ""
    address: str = ""
    window: int = 32_768
    headers: dict[str, str] = field(default_factory=dict)

    @property
    def budget(self) -> int:
        if self.service.form == "local":  # what the server is told to hold, with room for the frame and the answer
            return self.window * 85 // 100
        if self.service.name == "openrouter" and "nemotron" not in self.model.lower():
            return C.BUDGETS["openrouter-free"]
        return self.service.budget

    def chat(self, system: str, user: str, temperature: float = 0.1) -> str:
        return _FORMS[self.service.form](self, (self.address or self.service.address).rstrip("/"), system, user, temperature)


def _messages(system: str, user: str) -> list[dict]:
    return [{"role": "system", "content": system}, {"role": "user", "content": user}]


def _bearer(chat: Chat) -> dict[str, str]:
    return {**chat.headers, **({"Authorization": f"Bearer {chat.key}"} if chat.key else {})}


def _text(found, *path) -> str:
    """The text at a path of an answer; an answer of another shape is a failed call."""
    try:
        for step in path:
            found = found[step]
        return (found or "").strip()
    except (LookupError, TypeError, AttributeError) as error:
        raise M.ModelError(502, "an answer without text") from error


def _completions(chat: Chat, address: str, system: str, user: str, temperature: float) -> str:
    body = {"model": chat.model, "messages": _messages(system, user), "temperature": temperature}
    return _text(call(f"{address}/chat/completions", body, _bearer(chat)), "choices", 0, "message", "content")


def _content(chat: Chat, address: str, system: str, user: str, temperature: float) -> str:
    part = lambda text: {"parts": [{"text": text}]}
    body = {"systemInstruction": part(system), "contents": [{"role": "user", **part(user)}], "generationConfig": {"temperature": temperature}}
    answer = call(f"{address}/models/{chat.model}:generateContent", body, {**chat.headers, "x-goog-api-key": chat.key})
    try:
        return "".join(p.get("text", "") for p in answer["candidates"][0]["content"]["parts"]).strip()
    except (LookupError, TypeError, AttributeError) as error:
        raise M.ModelError(502, "an answer without text") from error


def _local(chat: Chat, address: str, system: str, user: str, temperature: float) -> str:
    model = chat.model or _text(call(f"{address}/api/tags", timeout=5), "models", 0, "name")
    body = {"model": model, "messages": _messages(system, user), "stream": False, "options": {"temperature": temperature, "num_ctx": chat.window}}
    return _text(call(f"{address}/api/chat", body, chat.headers), "message", "content")


_FORMS = {"completions": _completions, "content": _content, "local": _local}


class Library:
    """A model inside the worker, by an optional library; it is loaded once a worker, when first asked."""

    _loaded: dict[tuple, object] = {}

    def __init__(self, kind: str, model: str, window: int = 32_768, answer: int = 1024):
        self.kind, self.model, self.window, self.answer = kind, model, window, answer

    @property
    def budget(self) -> int:
        return C.BUDGETS["transformers"] if self.kind == "transformers" else self.window * 85 // 100

    def _load(self):
        key = (self.kind, self.model, self.window)
        if key not in self._loaded:
            try:
                if self.kind == "transformers":
                    from transformers import pipeline

                    self._loaded[key] = pipeline("text-generation", model=self.model)
                else:
                    from llama_cpp import Llama

                    self._loaded[key] = Llama(model_path=self.model, n_ctx=self.window, verbose=False)
            except ImportError as error:
                raise M.ModelError(501, f"{self.kind} is not installed") from error
        return self._loaded[key]

    def chat(self, system: str, user: str, temperature: float = 0.1) -> str:
        model = self._load()
        if self.kind == "transformers":
            said = model(_messages(system, user), max_new_tokens=self.answer, temperature=temperature, do_sample=temperature > 0)
            return _text(said, 0, "generated_text", -1, "content")
        return _text(model.create_chat_completion(_messages(system, user), temperature=temperature, max_tokens=self.answer), "choices", 0, "message", "content")


def setting(name: str, default: str = "") -> str:
    return os.environ.get(name, "").strip() or default


def read_settings(path: str) -> dict[str, str]:
    """NAME=value lines of a settings file; those that the environment lacks are added to it."""
    found = {}
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            name, mark, value = line.strip().removeprefix("export ").partition("=")
            if mark and not name.startswith("#"):
                found[name.strip()] = value.strip().strip("'\"")
    for name, value in found.items():
        os.environ.setdefault(name, value)
    return found


def connect(name: str, model: str | None = None, keys: list[str] | None = None, address: str | None = None, window: int | None = None, sleep=None) -> M.Model:
    """A service's model, with its settings from the environment; several keys take turns."""
    service = SERVICES[name]
    model = model or setting(*service.model)
    at = address or (setting(service.address_setting) if service.address_setting else "")
    held = window or int(setting("OLLAMA_NUM_CTX", "32768"))
    if service.keys is None:
        return Chat(service, model, address=at, window=held)
    keys = keys or M.keys_from_environment(service.keys)
    if not keys:
        raise M.ModelError(401, f"no key in {service.keys}")
    one = lambda key: Chat(service, model, key, at, held)
    turns = M.Retrying(one, keys, **({"sleep": sleep} if sleep else {}))
    turns.budget = one(keys[0]).budget
    return turns


for _service in SERVICES.values():
    M.register(_service.name, lambda _n=_service.name, **options: connect(_n, **options), *_service.aliases)
M.register("transformers", lambda model=None, **options: Library("transformers", model or setting("LOCAL_MODEL", "Qwen/Qwen2.5-Coder-7B-Instruct"), **options), "local", "gpu")
M.register("llama-cpp", lambda model=None, **options: Library("llama-cpp", model or setting("GGUF_MODEL"), **options), "gguf", "llama_cpp", "local-gguf", "32b")


def catalogue(spark: SparkSession, name: str, address: str | None = None, key: str = "", configured: str | None = None) -> DataFrame:
    """model, configured: the models that a service lists, by name, and whether it is the one in the settings."""
    service = SERVICES[name]
    at = (address or service.address).rstrip("/")
    if service.form == "local":
        ids = [x["name"] for x in call(f"{at}/api/tags").get("models", [])]
    elif service.form == "content":
        ids = [x["name"].removeprefix("models/") for x in call(f"{at}/models", headers={"x-goog-api-key": key}).get("models", [])]
    else:
        ids = [x["id"] for x in call(f"{at}/models", headers={"Authorization": f"Bearer {key}"}).get("data", [])]
    chosen = setting(*service.model) if configured is None else configured
    return spark.createDataFrame([(x,) for x in ids], "model string").distinct().withColumn("configured", F.col("model") == chosen).orderBy("model")


def is_listed(models: DataFrame) -> bool:
    """Whether the configured model is in a catalogue."""
    return not models.filter("configured").isEmpty()
