"""python -m vistaforge --input_dir FOLDER --global_model MODULE:FACTORY --local_model MODULE:FACTORY [--index_dir D] [any setting]

Builds (or reuses) the index of a folder and prints what it holds. Every field of ``serve.Config`` is an option.
"""

from __future__ import annotations

import argparse
import dataclasses
import importlib
import typing

from vistaforge.operators.serve import Config


def _value(kind, text: str):
    if kind is bool:
        return text.lower() in ("1", "true", "yes")
    if "tuple" in str(kind):
        return None if text.lower() == "none" else tuple(int(x) for x in text.replace("(", "").replace(")", "").split(","))
    return kind(text)


def parsed(args: list[str] | None = None) -> tuple[Config, argparse.Namespace]:
    """(settings, other options) of a command line; options not given keep their defaults."""
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    kinds = typing.get_type_hints(Config)
    for f in dataclasses.fields(Config):
        p.add_argument(f"--{f.name}", default=argparse.SUPPRESS, type=lambda t, k=kinds[f.name]: _value(k, t))
    p.add_argument("--index_dir", default=None)
    p.add_argument("--global_model", required=True)
    p.add_argument("--local_model", required=True)
    given = vars(p.parse_args(args))
    rest = argparse.Namespace(**{k: given.pop(k) for k in ("index_dir", "global_model", "local_model")})
    return Config().with_options(**given), rest


def factory(name: str):
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def main(args: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from vistaforge.plans.index import build_index

    config, rest = parsed(args)
    spark = SparkSession.builder.appName("vistaforge").getOrCreate()
    index = build_index(spark, config.input_dir, config, factory(rest.global_model), factory(rest.local_model), rest.index_dir)
    print({"images": index.images.count(), "vectors": index.vectors.count(), "edges": index.edges.count(), "features": index.features_path})


if __name__ == "__main__":
    main()
