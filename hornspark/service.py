"""Programs over HTTP: load, list, query, change and evaluate them, with JSON in and out.

A thin layer over Program for a trusted network: requests are answered one at a time, answers are made on the driver, so
queries should be of the size that a caller can read.
"""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession

from hornspark.engine import Engine, Program
from hornspark.lang.syntax import LanguageError
from hornspark.operators.relation import Relation
from hornspark.snapshots import json_value, value_of


class Service:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame | Relation] | None = None):
        self.engine, self.tables = Engine(spark), dict(tables or {})
        self.sources: dict[str, str] = {}
        self.programs: dict[str, Program] = {}
        self.lock = threading.Lock()

    def load(self, name: str, source: str) -> dict:
        program = self.engine.program(source, check=False)
        for n in program.undefined & set(self.tables):
            program.bind(n, self.tables[n])
        program.check()
        self.sources[name], self.programs[name] = source, program
        return self.described(name)

    def described(self, name: str, source: bool = False) -> dict:
        return {"name": name, "predicates": self._program(name).relations()} | ({"source": self.sources[name]} if source else {})

    def _program(self, name: str) -> Program:
        if name not in self.programs:
            raise KeyError(f"no program {name}")
        return self.programs[name]

    def answer(self, method: str, path: list[str], body: dict) -> dict:
        """The answer to one request; KeyError: not found, LanguageError: a bad request."""
        with self.lock:
            match method, path:
                case "POST", ["query"]:
                    return self._rows(self._program(body["program"]).query(body["query"]))
                case "POST", ["eval"]:
                    p = self.engine.program(body["source"])
                    if body.get("query"):
                        return self._rows(p.query(body["query"]))
                    return {"results": {n: self._rows(p.relation(n))["results"] for n in p.relations()}}
                case "GET", ["programs"]:
                    return {"programs": [self.described(n) for n in sorted(self.programs)]}
                case "POST", ["programs"]:
                    return self.load(body["name"], body["source"])
                case "GET", ["programs", name]:
                    return self.described(name, source=True)
                case "DELETE", ["programs", name]:
                    self._program(name)
                    del self.programs[name], self.sources[name]
                    return {"message": f"{name} is gone"}
                case "POST", ["programs", name, "reload"]:
                    self._program(name)
                    return self.load(name, self.sources[name])
                case "POST", ["programs", name, ("insert" | "retract") as what]:
                    getattr(self._program(name), what)(body["relation"], tuple(map(value_of, body["tuple"])))
                    return {"message": f"{what}: done"}
                case "POST", ["admin", "reload-all"]:
                    return {"programs": [self.load(n, s) for n, s in list(self.sources.items())]}
            raise KeyError("no such place")

    @staticmethod
    def _rows(r: Relation) -> dict:
        return {"results": [list(map(json_value, x)) for x in r.rows()]}

    def serve(self, host: str = "127.0.0.1", port: int = 8090) -> ThreadingHTTPServer:
        """Start a server in a thread; its shutdown() ends it."""
        service = self

        class Handler(BaseHTTPRequestHandler):
            def _do(self):
                try:
                    size = int(self.headers.get("Content-Length") or 0)
                    body = json.loads(self.rfile.read(size)) if size else {}
                    code, out = 200, service.answer(self.command, [x for x in self.path.split("?")[0].split("/") if x], body)
                except KeyError as e:
                    code, out = 404, {"error": str(e.args[0])}
                except (LanguageError, ValueError) as e:
                    code, out = 400, {"error": str(e)}
                except Exception as e:
                    code, out = 500, {"error": str(e).split("\n")[0]}
                data = json.dumps(out).encode()
                self.send_response(code)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            do_GET = do_POST = do_DELETE = _do

            def log_message(self, *_):
                pass

        server = ThreadingHTTPServer((host, port), Handler)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        return server
