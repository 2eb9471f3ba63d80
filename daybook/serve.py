"""The engine's questions over JSON-RPC on standard streams and over HTTP on this machine, and completions of names for a shell."""

from __future__ import annotations

import datetime as dt
import json
import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import TextIO
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import DataFrame, functions as F

from .app import Daybook

#: Rows of one reply.
MOST = 200
FILTERS = ("since", "until", "tag", "about", "group")
#: Columns with the writer's own words: a reply without raw text leaves them out.
RAW = ("text", "raw_text", "sentence", "snippet")


@dataclass(frozen=True)
class Question:
    """A method of Daybook by name, with the arguments it must and may be given."""

    about: str
    ask: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    takes: tuple[str, ...] = field(default=())

    def schema(self) -> dict:
        return {"type": "object", "properties": {n: {"type": "string"} for n in (*self.needs, *self.takes)}, "required": list(self.needs)}


def _day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


QUESTIONS = {
    "overview": Question("how much there is", lambda b: b.stats()),
    "mood": Question("mood by month", lambda b, **w: b.mood(**w), (), FILTERS),
    "tags": Question("the commonest tags", lambda b, **w: b.tags(**w), (), FILTERS),
    "notes": Question("the notes that come up most", lambda b, **w: b.notes(**w), (), FILTERS),
    "note": Question("one note and how it comes up", lambda b, name: b.note(name), ("name",)),
    "day": Question("the entries of a day", lambda b, day: b.show(_day(day)), ("day",)),
    "on_this_day": Question("the same day in other years", lambda b, day: b.on_this_day(_day(day)), ("day",)),
    "similar": Question("entries like those of a day", lambda b, day: b.similar(_day(day)), ("day",)),
    "search": Question("entries by keywords", lambda b, question, **w: b.search(question, **w), ("question",), FILTERS),
    "metric": Question("a metric by month", lambda b, key, **w: b.metric(key, **w), ("key",), FILTERS),
    "metrics": Question("all metrics", lambda b: b.metrics()),
    "compare": Question("two periods side by side", lambda b, first, second: b.compare(first, second), ("first", "second")),
    "review": Question("a period in parts", lambda b, period: b.review(period), ("period",)),
    "digest": Question("weeks, months or years", lambda b, kind: b.digest(kind), ("kind",)),
    "insights": Question("what goes with mood", lambda b, **w: b.insights(**w), (), FILTERS),
    "graph": Question("notes that come up together", lambda b, name: b.linked_with(name), ("name",)),
    "broken_links": Question("links to nothing", lambda b: b.unresolved()),
    "unlinked": Question("names that aren't links", lambda b: b.unlinked()),
    "lapsed": Question("notes gone quiet", lambda b: b.lapsed()),
    "streaks": Question("days in a row", lambda b, **w: b.streaks(**w), (), FILTERS),
}


def rows(found: DataFrame, raw: bool = True, most: int = MOST) -> list[dict]:
    """The first rows of a result as plain values; the limit is the reply's, not the question's."""
    keep = [c for c in found.columns if raw or c not in RAW]
    return [json.loads(json.dumps(r.asDict(True), default=str)) for r in found.select(*keep).limit(most).collect()]


def asked(book: Daybook, name: str, given: dict, raw: bool = True) -> list[dict]:
    """ValueError for an unknown question, a missing argument or one it doesn't take."""
    question = QUESTIONS.get(name)
    if question is None:
        raise ValueError(f"unknown: {name}")
    if missing := [n for n in question.needs if not given.get(n)]:
        raise ValueError(f"{name} needs {', '.join(missing)}")
    if more := set(given) - {*question.needs, *question.takes}:
        raise ValueError(f"{name} takes no {', '.join(sorted(more))}")
    return rows(question.ask(book, **given), raw)


class Rpc:
    """JSON-RPC 2.0, one message a line: initialize, ping, tools/list, tools/call."""

    def __init__(self, book: Daybook, raw: bool = True):
        self.book, self.raw = book, raw

    def result(self, method: str, given: dict):
        if method == "initialize":
            return {"protocolVersion": given.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "daybook", "version": "1"}}
        if method == "ping":
            return {}
        if method == "tools/list":
            return {"tools": [{"name": n, "description": q.about, "inputSchema": q.schema()} for n, q in QUESTIONS.items()]}
        if method == "tools/call":
            try:
                text, failed = json.dumps(asked(self.book, given.get("name", ""), given.get("arguments") or {}, self.raw), ensure_ascii=False), False
            except Exception as wrong:  # a question that fails is an answer; the server goes on
                text, failed = str(wrong).split("\n")[0], True
            return {"content": [{"type": "text", "text": text}], "isError": failed}
        raise KeyError(method)

    def reply(self, line: str) -> dict | None:
        """What to send back; nothing for a notification."""
        error = lambda code, why, number=None: {"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": why}}
        try:
            message = json.loads(line)
        except ValueError:
            return error(-32700, "no JSON")
        if not isinstance(message, dict) or not isinstance(message.get("method"), str):
            return error(-32600, "no request")
        if "id" not in message:
            return None
        try:
            return {"jsonrpc": "2.0", "id": message["id"], "result": self.result(message["method"], message.get("params") or {})}
        except KeyError:
            return error(-32601, f"unknown method: {message['method']}", message["id"])

    def serve(self, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
        for line in source:
            if line.strip() and (reply := self.reply(line)) is not None:
                print(json.dumps(reply, ensure_ascii=False), file=sink, flush=True)


def http_server(book: Daybook, port: int = 0, raw: bool = True, answer: Callable[[str], object] | None = None) -> ThreadingHTTPServer:
    """GET /api/<question>?argument=... on 127.0.0.1, refused to other hosts' pages. /api/ask?question=... streams what `answer` yields."""

    class Handler(BaseHTTPRequestHandler):
        def send(self, code: int, body) -> None:
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            if self.headers.get("Host", "").rsplit(":", 1)[0] not in ("127.0.0.1", "localhost") or self.headers.get("Sec-Fetch-Site", "none") not in ("none", "same-origin"):
                return self.send(403, {"error": "only from this machine"})
            url = urlsplit(self.path)
            name, given = unquote(url.path.removeprefix("/api/")), dict(parse_qsl(url.query))
            if name == "ask" and answer is not None and given.get("question"):
                self.send_response(200)
                self.send_header("Content-Type", "text/event-stream; charset=utf-8")
                self.end_headers()
                for piece in answer(given["question"]):
                    self.wfile.write(f"data: {json.dumps(piece, ensure_ascii=False)}\n\n".encode())
                return None
            try:
                return self.send(200, asked(book, name, given, raw))
            except ValueError as wrong:
                return self.send(404 if name not in QUESTIONS else 400, {"error": str(wrong)})

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def completions(book: Daybook, kind: str, prefix: str, most: int = 50) -> list[str]:
    """Names that begin so, whatever their case: notes, tags, metrics, days, months, kinds or properties."""
    view, month = book.view, F.date_format("entry_date", "yyyy-MM")
    of = {
        "notes": lambda: view["note_names"].select(F.col("name").alias("x")),
        "tags": lambda: view["entry_tags"].select(F.col("tag").alias("x")),
        "metrics": lambda: view["entry_metrics"].select(F.col("key").alias("x")),
        "days": lambda: view["entries"].select(F.col("entry_date").cast("string").alias("x")),
        "months": lambda: view["entries"].select(month.alias("x")),
        "kinds": lambda: view["notes"].select(F.col("kind").alias("x")),
        "properties": lambda: view["note_property_values"].select(F.col("key").alias("x")),
    }[kind]()
    begin = F.startswith(F.lower("x"), F.lit(prefix.lower()))
    return [r.x for r in of.where(begin).distinct().orderBy("x").limit(most).collect()]


def completion_script(commands: list[str], shell: str = "bash") -> str:
    """A script that completes the commands."""
    words = " ".join(sorted(commands))
    if shell == "fish":
        return f"complete -c daybook -f -n __fish_use_subcommand -a '{words}'\n"
    return f'_daybook() {{ COMPREPLY=($(compgen -W "{words}" -- "${{COMP_WORDS[COMP_CWORD]}}")); }}\ncomplete -F _daybook daybook\n'
