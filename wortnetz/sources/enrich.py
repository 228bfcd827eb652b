"""Look-up services: titles, addresses, model answers and text vectors, offline or by request."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import geo_fields


class Enricher(Protocol):
    """Adds a service's columns to each row; a failed look-up gives nulls and a text in ``error``."""

    def enrich(self, df: DataFrame, keys: Sequence[str]) -> DataFrame: ...


class LookupEnricher:
    """Offline: a table of answers, made unique by key."""

    def __init__(self, answers: DataFrame):
        self.answers = answers

    def enrich(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        found = self.answers.dropDuplicates(list(keys)).withColumn("__hit", F.lit(True))
        return df.join(found, list(keys), "left").withColumn("error", F.when(F.col("__hit").isNull(), F.lit("not found"))).drop("__hit")


class RequestEnricher:
    """By request: ``ask`` takes a list of key tuples, at most ``batch`` of them, and returns as many dicts.

    Distinct keys are asked once. ``pause`` seconds lie between two requests of a worker, and ``workers`` bounds how many
    ask at a time. An exception fails its batch alone: these rows get nulls and the message.
    """

    def __init__(self, ask: Callable[[list[tuple]], list[dict]], schema: str, batch: int = 50, pause: float = 0.0, workers: int = 1):
        self.ask, self.schema, self.batch, self.pause, self.workers = ask, schema, batch, pause, workers

    def enrich(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        ask, batch, pause, names = self.ask, self.batch, self.pause, list(keys)
        wanted = df.select(*names).distinct().repartition(self.workers)
        types = ", ".join(f"`{n}` {t}" for n, t in wanted.dtypes)
        fields = [x.strip().split(" ")[0].strip("`") for x in self.schema.split(",")]

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last = 0.0
            for rows in parts:
                for k in range(0, len(rows), batch):
                    part = rows.iloc[k : k + batch]
                    time.sleep(max(0.0, last + pause - time.monotonic()))
                    last = time.monotonic()
                    try:
                        answers, error = ask(list(part.itertuples(index=False, name=None))), None
                    except Exception as e:  # the service's own failures; they are reported per row
                        answers, error = [{}] * len(part), f"{type(e).__name__}: {e}"
                    yield pd.concat([part.reset_index(drop=True), pd.DataFrame([{f: a.get(f) for f in fields} for a in answers], columns=fields)], axis=1).assign(error=error)

        found = wanted.mapInPandas(run, f"{types}, {self.schema}, error string")
        return df.join(found, names, "left")


def chat_request(model: str, system: str | None, user: Column, temperature: float | None = 0.0, max_tokens: int | None = None) -> Column:
    """The JSON body of a chat completion per row; each option is there exactly if it is given."""
    messages = ([F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))] if system is not None else []) + [F.struct(F.lit("user").alias("role"), user.alias("content"))]
    fields = [F.lit(model).alias("model"), F.array(*messages).alias("messages")]
    fields += [F.lit(v).alias(k) for k, v in (("temperature", temperature), ("max_tokens", max_tokens)) if v is not None]
    return F.to_json(F.struct(*fields))


#: Fixed value: what stands before a word whose vector is asked for.
VECTOR_PREFIX = "Das Wort ist: "


def vector_requests(df: DataFrame, column: str, model: str, size: int = 50, prefix: str = VECTOR_PREFIX) -> DataFrame:
    """(chunk, body): the JSON bodies of requests for the vectors of a column's distinct words, ``size`` words each."""
    from ..operators.sampling import chunks

    w = chunks(df.select(F.col(column).alias("__w")).where("__w IS NOT NULL").distinct(), size, "__w")
    inputs = F.transform(F.array_sort(F.collect_list("__w")), lambda x: F.concat(F.lit(prefix), x))
    return w.groupBy("chunk").agg(F.to_json(F.struct(F.lit(model).alias("model"), inputs.alias("input"))).alias("body"))


def vector_answers(df: DataFrame, inputs: str = "inputs", body: str = "body") -> DataFrame:
    """(word, vec): the vectors of all answers in one table; the k-th of a body belongs to the k-th word it was asked for.

    A body that cannot be read, or holds another number of vectors than there are words, gives its words null.
    """
    found = F.from_json(F.col(body), "array<array<double>>")
    fitting = F.coalesce(F.when(F.size(found) == F.size(inputs), found), F.array().cast("array<array<double>>"))
    # zipped before rows are made, so that a body is parsed once, not once a word
    return df.select(F.explode(F.zip_with(inputs, fitting, lambda w, v: F.struct(w.alias("word"), v.alias("vec")))).alias("r")).select("r.word", "r.vec")


class Secret:
    """A key that stands in an environment variable; it is read when it is needed and never shown or stored."""

    def __init__(self, variable: str):
        self.variable = variable

    def value(self) -> str:
        found = os.environ.get(self.variable)
        if not found:
            raise ValueError(f"{self.variable} is not set")
        return found

    def __repr__(self) -> str:
        return f"Secret({self.variable!r})"


def chat_answer(body: Column) -> Column:
    return F.from_json(body, "choices array<struct<message:struct<content:string>>>")["choices"][0]["message"]["content"]


def prompt(template: str, **columns: Column) -> Column:
    """A template with ``{name}`` places filled per row."""
    out = F.lit(template)
    for name, value in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def title_url(base: str, titles: Column) -> Column:
    """A title query for an array of at most 50 titles."""
    return F.concat(F.lit(base), F.lit("?action=query&format=json&redirects=1&titles="), F.url_encode(F.array_join(titles, "|")))


def reverse_url(base: str, latitude: Column, longitude: Column, zoom: int = 13, language: str = "en-US") -> Column:
    """A reverse-geocoding query for coordinates, which are rounded to the two digits that places are looked up by."""
    at = lambda c: F.url_encode(F.format_string("%.2f", c.cast("double")))
    return F.concat(F.lit(base), F.lit(f"?accept-language={language}&format=json&zoom={zoom}&lat="), at(latitude), F.lit("&lon="), at(longitude))


def parse_place(body: Column) -> Column:
    """struct(locality, region, country) of an answer; nulls where it has no address."""
    fields = ("city", "town", "village", "municipality", "hamlet", "state", "county", "province", "country")
    return geo_fields(F.from_json(body, f"address struct<{', '.join(f'{x}: string' for x in fields)}>")["address"])


def parse_titles(body: str) -> list[dict]:
    """(word, wikipedia_page, page_id, title) of each title in a query's answer; missing pages are rows too."""
    query = json.loads(body).get("query", {})
    renamed = {x["to"]: x["from"] for x in query.get("normalized", [])}
    out = []
    for page in query.get("pages", {}).values():
        here = "missing" not in page and "invalid" not in page
        out.append({"word": renamed.get(page["title"], page["title"]), "wikipedia_page": here, "page_id": page.get("pageid") if here else None, "title": page["title"] if here else None})
    return out
