"""Tools over an index, a question-answering loop with verified citations, an offline policy and a response cache."""

from __future__ import annotations

import dataclasses
import json
import os
import sqlite3
import time
from abc import ABC, abstractmethod
from collections.abc import Callable
from typing import Any

from pyspark.sql import functions as F

from citegraph.functions.text import condense, extract_json, prompt_hash
from citegraph.operators import graph, lookup
from citegraph.plans.index import Index

SOURCE_LIMIT = 4000


@dataclasses.dataclass
class ToolResult:
    tool: str
    ok: bool
    payload: dict = dataclasses.field(default_factory=dict)
    error: str | None = None


@dataclasses.dataclass
class Tool:
    name: str
    description: str
    arguments: dict[str, str]
    run: Callable[..., dict]

    def signature(self) -> str:
        return f"{self.name}({', '.join(f'{k}: {v}' for k, v in self.arguments.items())})"


class Failed(Exception):
    """A tool's answer is that it found nothing."""


class ToolBox:
    """The seven tools; every call is logged, no call raises."""

    def __init__(self, index: Index, token_budget: int = 6000):
        self.index, self.token_budget = index, token_budget
        self.log: list[dict] = []
        self.last_trace: dict | None = None
        tools = (
            Tool("search_code", "Find code by words and meaning.", {"query": "string", "top_k": "int, 8 unless given"}, self.search_code),
            Tool("expand_context", "Walk calls outward from what a search finds, within a token budget.", {"query": "string", "token_budget": "int", "max_hops": "int, 2 unless given"}, self.expand_context),
            Tool("read_chunk", "The source of one chunk, by its id or name.", {"chunk_id": "string"}, self.read_chunk),
            Tool("find_callers", "What calls a chunk.", {"chunk_id": "string"}, lambda chunk_id: self._edge(chunk_id, graph.callers, "callers")),
            Tool("find_callees", "What a chunk calls.", {"chunk_id": "string"}, lambda chunk_id: self._edge(chunk_id, graph.callees, "callees")),
            Tool("list_symbols", "The definitions of a file in their order.", {"path": "string"}, self.list_symbols),
            Tool("grep_repo", "Lines that match an expression or contain a text.", {"pattern": "string", "max_results": "int, 20 unless given"}, self.grep_repo),
        )
        self.tools = {t.name: t for t in tools}

    def names(self) -> list[str]:
        return list(self.tools)

    def describe(self) -> str:
        return "\n".join(f"- {t.signature()}: {t.description}" for t in self.tools.values())

    def call(self, name: str, arguments: dict[str, Any] | None = None) -> ToolResult:
        tool = self.tools.get(name)
        try:
            if tool is None:
                raise Failed(f"unknown tool '{name}'; there are {', '.join(self.tools)}")
            out = ToolResult(name, True, tool.run(**(arguments or {})))
        except Failed as reason:
            out = ToolResult(name, False, error=str(reason))
        except TypeError as reason:
            out = ToolResult(name, False, error=f"bad arguments: {reason}")
        except Exception as reason:  # noqa: BLE001  whatever a tool meets is an answer to the model
            out = ToolResult(name, False, error=f"{type(reason).__name__}: {reason}")
        self.log.append({"tool": name, "arguments": arguments, "ok": out.ok, "error": out.error})
        return out

    def search_code(self, query: str, top_k: int = 8) -> dict:
        return {"query": query, "results": self.index.search(query, "hybrid", top_k)}

    def expand_context(self, query: str, token_budget: int | None = None, max_hops: int = 2, top_k: int = 12) -> dict:
        rows, self.last_trace = self.index.search_with_expansion(query, top_k, token_budget=token_budget or self.token_budget, max_hops=max_hops)
        return {"query": query, "results": rows, "trace": self.last_trace}

    def _found(self, chunk_id: str) -> dict:
        row = self.index.get(chunk_id)
        if row is None:
            named = lookup.by_name(self.index.chunks, chunk_id).orderBy("path", "start_line").first()
            row = named.asDict() if named else None
        if row is None:
            raise Failed(f"no chunk '{chunk_id}'")
        return row

    def read_chunk(self, chunk_id: str) -> dict:
        row = self._found(chunk_id)
        return {**{k: row[k] for k in ("chunk_id", "path", "kind", "qualified_name", "start_line", "end_line", "signature", "docstring")}, "citation": f"{row['path']}:{row['start_line']}-{row['end_line']}", "source": row["source"][:SOURCE_LIMIT], "truncated": len(row["source"]) > SOURCE_LIMIT}

    def _edge(self, chunk_id: str, side: Callable, name: str) -> dict:
        row = self._found(chunk_id)
        near = side(self.index.graph.edges, row["chunk_id"]).withColumnRenamed("node", "chunk_id")
        rows = self.index.chunks.join(F.broadcast(near), "chunk_id").orderBy("chunk_id").select("chunk_id", "path", "qualified_name", "start_line", "end_line").collect()
        return {"chunk_id": row["chunk_id"], name: [{**r.asDict(), "citation": f"{r.path}:{r.start_line}-{r.end_line}"} for r in rows]}

    def list_symbols(self, path: str) -> dict:
        chunks = self.index.chunks
        rows = lookup.in_file(chunks, path).collect()
        if not rows:
            other = chunks.filter(F.contains("path", F.lit(path))).agg(F.min("path")).first()[0]
            if other is None:
                raise Failed(f"no file '{path}'")
            path, rows = other, lookup.in_file(chunks, other).collect()
        return {"path": path, "symbols": [{"chunk_id": r.chunk_id, "kind": r.kind, "qualified_name": r.qualified_name, "start_line": r.start_line, "end_line": r.end_line} for r in rows]}

    def grep_repo(self, pattern: str, max_results: int = 20) -> dict:
        rows = lookup.grep(self.index.chunks, pattern, max_results).collect()
        return {"pattern": pattern, "matches": [r.asDict() for r in rows]}


@dataclasses.dataclass
class Response:
    text: str
    model: str
    cached: bool = False


class Model(ABC):
    @abstractmethod
    def complete(self, messages: list[dict], temperature: float = 0.0, max_tokens: int = 1024) -> Response: ...


class OfflinePolicy(Model):
    """A fixed policy with the tools: search, walk if the question is about relations, read, ask for callers, answer with the three best citations."""

    # What makes a question one about relations, as substrings.
    RELATIONAL = ("call", "calls", "called", "caller", "callers", "callee", "invoke", "invoked", "uses", "used by", "depend", "depends", "flow", "trace", "reach", "chain", "downstream", "upstream", "relate")

    def __init__(self):
        self.calls = 0

    def decide(self, state: dict) -> tuple[str, dict]:
        question, top = str(state.get("question", "")), state.get("top_candidates") or []
        used = {o.get("tool") for o in state.get("observations") or []}
        relational = any(w in question.lower() for w in self.RELATIONAL)
        best = {"chunk_id": top[0]["chunk_id"]} if top else {}
        plan = [("search_code", True, {"query": question, "top_k": 8}), ("expand_context", relational, {"query": question, "token_budget": 4000, "max_hops": 2}), ("read_chunk", bool(top), best), ("find_callers", relational and bool(top), best)]
        last = int(state.get("step", 1)) >= int(state.get("max_steps", 6))
        for tool, wanted, arguments in plan:
            if wanted and tool not in used and not last:
                return tool, arguments
        names = [c["qualified_name"] for c in top[:3]]
        text = f"See {names[0]}" + (f", and also {', '.join(names[1:])}" if names[1:] else "") + "." if names else "Nothing in this repository matches the question."
        return "final_answer", {"answer": text, "citations": [c["citation"] for c in top[:3]]}

    def complete(self, messages: list[dict], temperature: float = 0.0, max_tokens: int = 1024) -> Response:
        self.calls += 1
        tool, arguments = self.decide(extract_json(messages[-1]["content"]) or {})
        return Response(json.dumps({"thought": f"next: {tool}", "tool": tool, "arguments": arguments}), "offline")


class CachedModel(Model):
    """A model behind a cache of its responses."""

    def __init__(self, model: Model, cache: ResponseCache, name: str):
        self.model, self.cache, self.name = model, cache, name

    def complete(self, messages: list[dict], temperature: float = 0.0, max_tokens: int = 1024) -> Response:
        key = prompt_hash(self.name, messages, temperature=temperature, max_tokens=max_tokens)
        if (hit := self.cache.get(key)) is not None:
            return Response(hit["text"], self.name, cached=True)
        out = self.model.complete(messages, temperature, max_tokens)
        self.cache.put(key, self.name, {"messages": messages}, {"text": out.text})
        return out


@dataclasses.dataclass
class Provider:
    """A named model and the environment variable that must be set for it to be asked, if any."""

    name: str
    model: Model | None
    needs_key: str | None = None

    def usable(self) -> bool:
        return self.needs_key is None or bool(os.environ.get(self.needs_key))


class Failover(Model):
    """The first usable provider that answers or whose answer is cached; those that fail before it are noted."""

    def __init__(self, providers: list[Provider], cache: ResponseCache):
        self.providers, self.cache, self.failures, self.cached = providers, cache, [], 0

    def complete(self, messages: list[dict], temperature: float = 0.0, max_tokens: int = 1024) -> Response:
        usable = [p for p in self.providers if p.usable()]
        if not usable:
            raise RuntimeError("no provider has its key set")
        for p in usable:
            try:
                out = CachedModel(p.model, self.cache, p.name).complete(messages, temperature, max_tokens)
            except Exception as reason:  # noqa: BLE001  whatever one provider meets, the next is asked
                self.failures.append({"model": p.name, "error": type(reason).__name__, "detail": str(reason)[:200]})
                continue
            self.cached += out.cached
            return Response(out.text, p.name, out.cached)
        raise RuntimeError(f"all providers failed: {', '.join(p.name for p in usable)}")

    def stats(self) -> dict:
        return {"failures": len(self.failures), **self.cache.stats()}


class ResponseCache:
    """Responses by the hash of their request in an SQLite file; reading one counts a hit, writing one again keeps its hits."""

    def __init__(self, path: str):
        self.db = sqlite3.connect(path)
        self.db.execute("create table if not exists responses (prompt_hash text primary key, model text, request text, response text, created_at real, hits integer default 0)")

    def get(self, key: str) -> dict | None:
        row = self.db.execute("update responses set hits = hits + 1 where prompt_hash = ? returning response", (key,)).fetchone()
        self.db.commit()
        return json.loads(row[0]) if row else None

    def put(self, key: str, model: str, request: dict, response: dict) -> None:
        self.db.execute("insert into responses (prompt_hash, model, request, response, created_at) values (?, ?, ?, ?, ?) on conflict (prompt_hash) do update set model = excluded.model, request = excluded.request, response = excluded.response, created_at = excluded.created_at", (key, model, json.dumps(request), json.dumps(response), time.time()))
        self.db.commit()

    def stats(self) -> dict:
        n, hits = self.db.execute("select count(*), coalesce(sum(hits), 0) from responses").fetchone()
        return {"entries": n, "hits": hits}

    def clear(self) -> None:
        self.db.execute("delete from responses")
        self.db.commit()

    def close(self) -> None:
        self.db.close()


@dataclasses.dataclass
class Answer:
    question: str
    answer: str = ""
    citations: list[dict] = dataclasses.field(default_factory=list)
    steps: list[dict] = dataclasses.field(default_factory=list)
    stopped: str = ""

    @property
    def valid(self) -> list[dict]:
        return [c for c in self.citations if c["valid"]]

    @property
    def supported(self) -> bool:
        return bool(self.valid)

    @property
    def validity(self) -> float:
        return len(self.valid) / len(self.citations) if self.citations else 0.0

    @property
    def cited_files(self) -> list[str]:
        return sorted({c["path"] for c in self.valid})

    @property
    def tools_used(self) -> list[str]:
        return list(dict.fromkeys(s["tool"] for s in self.steps))

    def to_dict(self) -> dict:
        return dataclasses.asdict(self) | {"supported": self.supported, "validity": self.validity, "cited_files": self.cited_files}


class Answerer:
    """At most `max_steps` actions, one JSON object each; what the final one cites is verified against the index."""

    def __init__(self, index: Index, model: Model | None = None, max_steps: int = 6, token_budget: int = 6000):
        self.index, self.model, self.max_steps, self.tools = index, model or OfflinePolicy(), max_steps, ToolBox(index, token_budget)

    def verify(self, raw: list) -> list[dict]:
        if not raw:
            return []
        spark = self.index.spark
        asked = spark.createDataFrame([(i, str(c)) for i, c in enumerate(raw)], "n int, raw string")
        return [r.asDict() for r in lookup.verify_citations(asked, self.index.chunks).orderBy("n").drop("n").collect()]

    def answer(self, question: str) -> Answer:
        out, top = Answer(question), []
        for step in range(1, self.max_steps + 1):
            seen = [{"tool": s["tool"], "ok": s["ok"], "error": s["error"], "result": condense(s["result"])} for s in out.steps[-4:]]
            state = {"question": question, "step": step, "max_steps": self.max_steps, "observations": seen, "top_candidates": top[:8]}
            messages = [{"role": "system", "content": "Answer questions on a repository. Act with one JSON object: thought, tool, arguments. Tools:\n" + self.tools.describe() + "\n- final_answer(answer: string, citations: list of path:start-end)"}, {"role": "user", "content": json.dumps(state, indent=2, default=str)}]
            reply = self.model.complete(messages)
            action = extract_json(reply.text)
            if not action or "tool" not in action:
                out.steps.append({"tool": "<malformed>", "ok": False, "error": "no usable action", "arguments": {}, "result": {"raw": reply.text[:400]}})
                continue
            tool, arguments = str(action["tool"]), action.get("arguments") or {}
            if tool == "final_answer":
                out.citations, out.answer, out.stopped = self.verify(arguments.get("citations") or []), str(arguments.get("answer", "")).strip(), "final_answer"
                out.steps.append({"tool": tool, "ok": True, "error": None, "arguments": arguments, "result": {}})
                return out
            done = self.tools.call(tool, arguments)
            out.steps.append({"tool": tool, "ok": done.ok, "error": done.error, "arguments": arguments, "result": done.payload})
            top += [r for r in done.payload.get("results") or [] if "chunk_id" in r and r not in top]
        out.stopped, out.answer = "step_budget_exhausted", "The steps ran out before an answer."
        return out
