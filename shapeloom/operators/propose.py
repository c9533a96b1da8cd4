"""Schema proposals: a supplied generator answers one prompt per document."""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable, Iterator
from multiprocessing.connection import Connection

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapeloom.functions.json_text import brace_slice, indented, indented_unicode, parse_strict
from shapeloom.operators.infer import document_tasks, infer_document_paths
from shapeloom.operators.manifest import dataset_of, route_by_complexity, target_path
from shapeloom.operators.render import render_schema
from shapeloom.operators.shred import DEFAULT_LEVELS, parse_documents, shred_documents

INSTRUCTION = "Give the JSON Schema of this document."

# Fixed value: message for a manifest path that names no dataset.
BAD_PATH = "Invalid file path structure in manifest"

# What is told of a document that is not JSON.
UNREADABLE = "unreadable document"

Generator = Callable[[list[str]], list[str | BaseException]]


def prompts(docs: DataFrame, instruction: str = INSTRUCTION) -> DataFrame:
    """Add ``prompt``: the instruction, then the document, indented; null if it is not JSON."""
    return docs.withColumn("prompt", F.concat(F.lit(f"{instruction}\n\n"), indented(F.col("json"))))


def _serve(make_generator: Callable[[], Generator], line: Connection, parents_end: Connection) -> None:
    """The child process: answers lists of prompts until its parent closes the line, or is gone."""
    parents_end.close()
    try:
        generate = make_generator()
        line.send(None)
    except Exception as problem:
        line.send(problem if _travels(problem) else RuntimeError(str(problem)))
        return
    while True:
        try:
            some = line.recv()
        except EOFError:
            return
        try:
            answers: list | Exception = list(generate(some))
        except Exception as problem:
            answers = problem
        try:
            line.send([_sent(a) for a in answers] if isinstance(answers, list) else _sent(answers))
        except OSError:
            return


def _travels(problem: BaseException) -> bool:
    return type(problem).__module__ == "builtins"


def _sent(answer: str | BaseException) -> str | BaseException:
    """An answer that can be sent on: exceptions keep their text, and whether they tell of time."""
    if not isinstance(answer, BaseException):
        return answer
    return TimeoutError(str(answer)) if isinstance(answer, TimeoutError) else RuntimeError(str(answer))


class _Answering:
    """A generator in a child process, killed and started anew when an answer takes too long."""

    def __init__(self, make_generator: Callable[[], Generator], deadline: float, load_deadline: float | None):
        self.make_generator, self.deadline, self.load_deadline = make_generator, deadline, load_deadline
        self.child = self.line = None

    def _start(self) -> None:
        context = multiprocessing.get_context("fork")
        self.line, other = context.Pipe()
        self.child = context.Process(target=_serve, args=(self.make_generator, other, self.line), daemon=True)
        self.child.start()
        other.close()
        problem = self._received(self.load_deadline, "generator not ready")
        if isinstance(problem, Exception):
            self.close()
            raise problem

    def _received(self, seconds: float | None, what: str):
        try:
            if not self.line.poll(seconds):
                self.close()
                raise TimeoutError(f"{what} within {seconds:g} s")
            return self.line.recv()
        except (EOFError, ConnectionError):
            code = self.child.exitcode
            self.close()
            raise RuntimeError(f"the generator died (exit code {code})") from None

    def __call__(self, some: list[str]) -> list[str | BaseException]:
        if self.child is None or not self.child.is_alive():
            self.close()
            self._start()
        self.line.send(some)
        answers = self._received(self.deadline, "no answer")
        if isinstance(answers, BaseException):
            raise answers
        return answers

    def close(self) -> None:
        if self.child is not None:
            self.line.close()
            self.child.kill()
            self.child.join()
            self.child = None


def propose_schemas(
    prompted: DataFrame,
    make_generator: Callable[[], Generator],
    batch_rows: int = 64,
    deadline: float | None = None,
    load_deadline: float | None = None,
) -> DataFrame:
    """Ask the generator for every ``file, prompt``; gives ``file, response, error``.

    ``make_generator`` is called once per partition, where the model would be loaded. The
    generator answers up to ``batch_rows`` prompts with a text or an exception each; an
    exception, raised or returned, becomes a row and never fails the job. A batch that raises is
    asked again prompt by prompt, so a document fails alone. A null prompt never reaches the
    generator.

    With a ``deadline`` (seconds) the generator runs in a child process of the task. When a batch
    is not answered in time the process is killed and started anew, and the batch is asked again
    prompt by prompt: a document that alone takes longer than the deadline becomes a row whose
    error begins with ``Timeout``. A process that dies is an error of the document it died on.
    ``load_deadline`` bounds ``make_generator`` in the same way. Without a deadline limits of time
    are the generator's own, told by ``TimeoutError``.
    """

    def describe(problem: BaseException) -> str:
        return f"Timeout: {problem}" if isinstance(problem, TimeoutError) else str(problem)

    def ask(generate: Generator, some: list[str]) -> list[str | BaseException]:
        try:
            answers = list(generate(some))
            if len(answers) != len(some):
                raise ValueError(f"{len(answers)} answers to {len(some)} prompts")
            return answers
        except Exception as problem:
            return [problem] if len(some) == 1 else [a for one in some for a in ask(generate, [one])]

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = None if deadline is None else _Answering(make_generator, deadline, load_deadline)
        try:
            yield from answered(generate, batches)
        finally:
            if deadline is not None:
                generate.close()

    def answered(generate: Generator | None, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers: list[str | BaseException] = [ValueError(UNREADABLE)] * len(batch)
            readable = [k for k, p in enumerate(batch["prompt"]) if isinstance(p, str)]
            try:
                if generate is None and readable:
                    generate = make_generator()
                for at in range(0, len(readable), batch_rows):
                    some = readable[at : at + batch_rows]
                    for k, got in zip(some, ask(generate, [batch["prompt"].iloc[k] for k in some])):
                        answers[k] = got
            except Exception as problem:
                for k in readable:
                    answers[k] = problem
            failed = [isinstance(a, BaseException) for a in answers]
            yield pd.DataFrame(
                {
                    "file": batch["file"],
                    "response": [None if bad else a for a, bad in zip(answers, failed)],
                    "error": [describe(a) if bad else None for a, bad in zip(answers, failed)],
                }
            )

    return prompted.select("file", "prompt").mapInPandas(
        answer, "file string, response string, error string"
    )


def propose_offline(
    docs: DataFrame, keys: list[str], levels: int = DEFAULT_LEVELS
) -> DataFrame:
    """A proposal per document without a model: the schema inferred from it alone."""
    nodes = shred_documents(parse_documents(docs), keys, levels)
    proposals = render_schema(infer_document_paths(nodes, keys, document_tasks(docs)), keys)
    return proposals.withColumnRenamed("schema_json", "response")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def extract_json_block(responses: DataFrame) -> DataFrame:
    """Add ``schema_text`` and ``valid``: the braced block if it is JSON, else all of the text."""
    block = brace_slice(F.col("response"))
    return (
        responses.withColumn("valid", parse_strict(block).isNotNull())
        .withColumn(
            "schema_text", F.when(F.col("valid"), block).otherwise(_stripped(F.col("response")))
        )
    )


def block_counts(extracted: DataFrame) -> DataFrame:
    return extracted.groupBy("dataset").agg(
        F.count_if("valid").alias("valid_blocks"), F.count_if(~F.col("valid")).alias("raw_texts")
    )


def saved_text(extracted: DataFrame) -> DataFrame:
    """The text as it goes to the schema file: indented if it is JSON, as it is otherwise."""
    return extracted.withColumn("saved", indented_unicode(F.col("schema_text")))


def proposal_outcomes(
    manifest: DataFrame, responses: DataFrame, root: str, model: str
) -> DataFrame:
    """A log row per pending document: ``original_file, model, status, message``.

    Skipped tiers leave no row. Paths without a dataset fail before any model is asked.
    """
    routed = route_by_complexity(manifest).withColumn("target", target_path(root))
    usable = dataset_of(F.col("file")).isNotNull()
    rows = routed.filter(~usable | (F.col("tier") != "skip")).join(
        responses.select("file", "response", "error"), "file", "left"
    )
    ok = usable & F.col("error").isNull() & F.col("response").isNotNull()
    return rows.select(
        F.col("file").alias("original_file"),
        F.when(usable, F.lit(model)).otherwise("N/A").alias("model"),
        F.when(ok, "success").otherwise("failed").alias("status"),
        F.when(~usable, BAD_PATH)
        .when(ok, F.concat(F.lit("Schema saved to "), F.col("target")))
        .otherwise(F.coalesce("error", F.lit("no response")))
        .alias("message"),
    )


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("model", "status").agg(F.count(F.lit(1)).alias("documents"))
