"""Backends, catalogues and fetching against a server of the test's own."""

import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from io import BytesIO
from urllib.parse import parse_qs, urlparse

import pytest

from cograph.plans import backends, extraction, models


def archive():
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("AndroidManifest.xml", "x")
        z.writestr("classes.dex", "x" * 200_000)
    return out.getvalue()


class Server(BaseHTTPRequestHandler):
    seen: list = []

    def answer(self, body, code=200):
        data = body if isinstance(body, bytes) else json.dumps(body).encode()
        self.send_response(code)
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):
        at = urlparse(self.path)
        if at.path == "/apk":
            key = parse_qs(at.query)["sha256"][0]
            self.answer(archive()) if key != "gone" else self.answer(b"no such file")
        elif at.path == "/models":
            self.answer({"data": [{"id": "b"}, {"id": "a"}, {"id": "b"}], "models": [{"name": "models/z"}]})
        elif at.path == "/api/tags":
            self.answer({"models": [{"name": "small"}]})
        else:
            self.answer({}, 404)

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.seen.append((self.path, dict(self.headers), body))
        key = self.headers.get("Authorization", "").removeprefix("Bearer ")
        if key in ("busy", "refused"):
            self.answer({}, {"busy": 429, "refused": 401}[key])
        elif key == "odd":
            self.answer({"choices": []})
        elif self.path.endswith("/chat/completions"):
            self.answer({"choices": [{"message": {"content": f" {body['messages'][1]['content']}! "}}]})
        elif self.path.endswith(":generateContent"):
            self.answer({"candidates": [{"content": {"parts": [{"text": "ge"}, {"text": "mini"}]}}]})
        else:
            self.answer({"message": {"content": f"{body['model']} {body['options']['num_ctx']}"}})

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def address():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_hosted(address, monkeypatch):
    for name, budget in (("openai", 80_000), ("openrouter", 200_000), ("nvidia", 120_000), ("groq", 4_000)):
        one = models.create(name, keys=["k"], address=address)
        assert one.chat("s", "hello") == "hello!" and one.budget == budget
    path, headers, body = Server.seen[-1]
    assert path == "/chat/completions" and headers["Authorization"] == "Bearer k" and [m["content"] for m in body["messages"]] == ["s", "hello"]
    assert models.create("nemotron", keys=["k"], model="other:free", address=address).budget == 30_000
    gemini = models.create("gemini", keys=["g"], address=address)
    assert gemini.chat("s", "u") == "gemini" and gemini.budget == 800_000 and models.short_of_budget(models.create("groq", keys=["k"]))
    assert {k.lower(): v for k, v in Server.seen[-1][1].items()}["x-goog-api-key"] == "g"
    monkeypatch.delenv("GROQ_API_KEY", raising=False)
    with pytest.raises(models.ModelError):
        models.create("groq")
    for at, key in enumerate(("one", "two")):
        monkeypatch.setenv(f"GROQ_API_KEY{at + 1}", key)
    assert models.keys_from_environment("GROQ_API_KEY") == ["one", "two"]


def test_key_turns_and_failures(address):
    waits = []
    turns = backends.connect("openai", keys=["refused", "busy", "good"], address=address, sleep=waits.append)
    assert turns.chat("s", "u") == "u!" and waits
    for key, status in (("odd", 502), ("busy", 429)):
        with pytest.raises(models.ModelError) as error:
            backends.Chat(backends.SERVICES["openai"], "m", key, address).chat("s", "u")
        assert error.value.status == status
    with pytest.raises(models.ModelError) as error:
        backends.Chat(backends.SERVICES["openai"], "m", "k", "http://127.0.0.1:9").chat("s", "u")
    assert error.value.status == 0


def test_local(address):
    one = models.create("ollama", address=address, window=1000)
    assert one.budget == 850 and one.chat("s", "u") == "small 1000"
    for name, budget in (("transformers", 32_768), ("gguf", 27_852)):
        library = models.create(name, model="none")
        assert library.budget == budget
        with pytest.raises(models.ModelError) as error:
            library.chat("s", "u")
        assert error.value.status == 501


def test_asked_by_tasks(spark, address):
    df = spark.createDataFrame([("a",), ("b",)], "prompt string")
    got = models.ask(df, models.create("openai", keys=["k"], address=address), "s").collect()
    assert sorted((r.response, r.error) for r in got) == [("a!", None), ("b!", None)]


def test_catalogue(spark, address, tmp_path, monkeypatch):
    listed = backends.catalogue(spark, "groq", address, "k", configured="b")
    assert [(r.model, r.configured) for r in listed.collect()] == [("a", False), ("b", True)] and backends.is_listed(listed)
    assert not backends.is_listed(backends.catalogue(spark, "gemini", address, "k", configured="b"))
    assert [r.model for r in backends.catalogue(spark, "ollama", address).collect()] == ["small"]
    monkeypatch.delenv("COGRAPH_TEST_A", raising=False)
    (tmp_path / "settings").write_text("# no\nexport COGRAPH_TEST_A='x y'\nbroken\n")
    assert backends.read_settings(str(tmp_path / "settings")) == {"COGRAPH_TEST_A": "x y"} and backends.setting("COGRAPH_TEST_A") == "x y"
    monkeypatch.delenv("COGRAPH_TEST_A", raising=False)


def test_fetching(spark, address):
    fetcher = extraction.HttpFetcher(f"{address}/apk", {"apikey": "k"})
    assert fetcher.fetch("x") == archive()
    with pytest.raises(ValueError):
        extraction.HttpFetcher(f"{address}/apk", most=1000).fetch("x")

    class Decoder:
        def slices(self, key, data):
            return f"{key} {len(data)}"

    work = spark.createDataFrame([("x",), ("gone",), ("had",)], "sha256 string")
    have = spark.createDataFrame([("had", "there")], "sha256 string, content string")
    files, failed = extraction.or_extracted(work, have, fetcher, Decoder(), tries=2)
    assert {(r.sha256, r.content) for r in files.collect()} == {("x", f"x {len(archive())}"), ("had", "there")}
    assert [(r.sha256, r.outcome) for r in failed.collect()] == [("gone", "download")]
