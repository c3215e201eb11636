"""Model-backed operators behind a plain interface: prompts in, texts out, a batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Makes a generator on a worker, where models are loaded; the generator maps a list of prompts to as many texts.
Factory = Callable[[], Callable[[list[str]], list[str]]]


@dataclass(frozen=True)
class Decoding:
    """What a model adapter is told: sampling with these values, or greedy if temperature is 0."""

    temperature: float = 0.0
    top_p: float = 1.0
    repetition_penalty: float = 1.0
    max_input: int = 1024
    max_new: int = 128
    batch: int = 4


ERROR_GENERATION = Decoding(temperature=0.25, top_p=0.90, repetition_penalty=1.05, max_input=4096, max_new=768, batch=4)
CORRECTION = Decoding()
TRANSLATION = Decoding(batch=32, max_input=512, max_new=512)


def generate(df: DataFrame, prompt: str, factory: Factory, out: str, batch: int = 4) -> DataFrame:
    """df with the generated text of each prompt. The generator is made once for a partition; ids travel with their rows,
    so results never depend on order."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in batches:
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch].copy()
                texts = model([p if p is not None else "" for p in part[prompt]])
                if len(texts) != len(part):
                    raise ValueError("a generator must return a text for each prompt")
                part[out] = texts
                yield part

    return df.mapInPandas(run, schema)


def back_translate(df: DataFrame, to_pivot: Factory, from_pivot: Factory, column: str = "sentence", batch: int = 32) -> DataFrame:
    """original, english (the pivot) and corrupted; rows that come back unchanged stay."""
    base = df.select(F.col(column).alias("original"))
    return generate(generate(base, "original", to_pivot, "english", batch), "english", from_pivot, "corrupted", batch)
