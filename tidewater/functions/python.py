"""The few functions that Spark's own can't express: Arrow-batched, registered on first use."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F


@F.pandas_udf("string")
def json_modify(texts: pd.Series, paths: pd.Series, values: pd.Series) -> pd.Series:
    """JSON_MODIFY along paths that go through arrays."""

    def put(text, path, value):
        if text is None:
            return None
        try:
            whole = json.loads(text)
        except ValueError:
            return None
        append = path.startswith("append ")
        steps = [int(i) if i else k for i, k in re.findall(r"\[(\d+)\]|\.([^.\[]+)", path.removeprefix("append ").strip())]
        try:
            new = json.loads(value) if value is not None else None
        except ValueError:
            new = value
        at = whole
        for here, after in zip(steps, [*steps[1:], None]):
            last = after is None
            if isinstance(here, int):
                if not isinstance(at, list) or here > len(at):
                    return text
                if here == len(at):
                    at.append(None)
            elif not isinstance(at, dict):
                return text
            if last:
                if append:
                    held = at[here] if isinstance(here, int) else at.setdefault(here, [])
                    held.append(new)
                else:
                    at[here] = new
            else:
                if not isinstance(here, int) and here not in at:
                    at[here] = [] if isinstance(after, int) else {}
                at = at[here]
        return json.dumps(whole, separators=(",", ":"), ensure_ascii=False)

    return pd.Series([put(*row) for row in zip(texts, paths, values)])


FUNCTIONS = {"json_modify": json_modify}
