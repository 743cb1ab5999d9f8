"""``python -m quillgraph.cli STAGE --folder F --models module:function``: stages, the gate, questions, a service.

The function takes no arguments and returns `stages.Models`.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from importlib import import_module

from pyspark.sql import SparkSession

from quillgraph.runtime import session, ship
from quillgraph.stages import STAGES, Workspace


def events(space: Workspace, question: str) -> Iterator[str]:
    """An answer as server-sent events: what was retrieved, each claim, the end; or an error."""
    say = lambda name, payload: f"event: {name}\ndata: {json.dumps(payload)}\n\n"
    try:
        found = space.ask(question)
        answer = found["answer"]
        yield say("retrieved", {"route": found["route"], "citable": sorted(found["ids"])})
        for claim in answer["claims"]:
            yield say("claim", claim)
        yield say("done", {"answerable": answer["answerable"], "refusal_reason": answer["refusal_reason"]})
    except Exception as e:
        yield say("error", {"error": f"{type(e).__name__}: {e}"[:300]})


def response(question: str, found: dict) -> dict:
    answer = found["answer"]
    cited = list(dict.fromkeys(c for claim in answer["claims"] for c in claim["citations"]))
    return {
        "question": question, "answerable": answer["answerable"], "answer": " ".join(c["text"] for c in answer["claims"]), "claims": answer["claims"], "refusal_reason": answer["refusal_reason"],
        "route": found["route"], "citations": cited, "retrieved": found["ids"],
    }


def service(space: Workspace, port: int = 8000) -> ThreadingHTTPServer:
    """A server of GET /health, POST /ask and POST /ask/stream, each with a JSON body {"question": …}."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, code: int, payload: dict) -> None:
            body = json.dumps(payload).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:
            if self.path != "/health":
                return self._reply(404, {"error": "not found"})
            try:
                self._reply(200, space.health())
            except Exception as e:
                self._reply(503, {"error": f"{type(e).__name__}: {e}"[:300]})

        def do_POST(self) -> None:
            if self.path not in ("/ask", "/ask/stream"):
                return self._reply(404, {"error": "not found"})
            try:
                question = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))["question"]
                if not isinstance(question, str) or not 1 <= len(question) <= 1000:
                    raise ValueError
            except (ValueError, KeyError, TypeError):
                return self._reply(422, {"error": "a question of 1 to 1000 characters is needed"})
            if self.path == "/ask":
                try:
                    return self._reply(200, response(question, space.ask(question)))
                except Exception as e:
                    return self._reply(503, {"error": f"{type(e).__name__}: {e}"[:300]})
            self.send_response(200)
            self.send_header("Content-Type", "text/event-stream")
            self.end_headers()
            for event in events(space, question):
                self.wfile.write(event.encode())
                self.wfile.flush()

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a stage; 1 if the gate finds a breach."""
    parser = argparse.ArgumentParser(prog="quillgraph")
    parser.add_argument("stage", choices=(*STAGES, "all", "verify", "ask", "stream", "serve"))
    parser.add_argument("--folder", required=True, help="where the tables lie; all executors must see it")
    parser.add_argument("--models", required=True, help="module:function that gives the models")
    parser.add_argument("--filings", help="fetch: JSON lines of filings")
    parser.add_argument("--question", help="ask, stream: what is asked")
    parser.add_argument("--budget", type=float, default=5.0, help="extract: US dollars that may be spent")
    parser.add_argument("--limit", type=int, help="extract: only so many chunks")
    parser.add_argument("--port", type=int, default=8000)
    given = parser.parse_args(args)
    spark = spark or session()
    ship(spark)
    module, _, name = given.models.partition(":")
    space = Workspace(spark, given.folder, getattr(import_module(module), name or "models")())
    options = {"fetch": {"filings": given.filings}, "extract": {"budget": given.budget, "limit": given.limit}}
    if given.stage == "verify":
        return int(bool(space.verify()))
    if given.stage == "ask":
        print(json.dumps(response(given.question, space.ask(given.question))))
    elif given.stage == "stream":
        for event in events(space, given.question):
            print(event, end="", flush=True)
    elif given.stage == "serve":
        service(space, given.port).serve_forever()
    else:
        for stage in STAGES if given.stage == "all" else (given.stage,):
            if stage != "fetch" or given.filings or given.stage == "fetch":
                getattr(space, stage)(**options.get(stage, {}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
