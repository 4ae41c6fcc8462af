"""Attributes of XMP packets inside photo files, by an XML parser in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

START, END = b"<x:xmpmeta", b"</x:xmpmeta>"


def attributes_of(data: bytes | None) -> dict[str, str]:
    """Attributes of the Description elements of a file's XMP packet, by local name; the last of a name wins. Bytes that are
    no UTF-8 are replaced; without a packet, or with one that is no XML, there are none."""
    data = data or b""
    begin, end = data.find(START), data.find(END)
    if begin < 0 or end < 0:
        return {}
    try:
        root = ElementTree.fromstring(data[begin : end + len(END)].decode("utf-8", "replace"))
    except ElementTree.ParseError:
        return {}
    local = lambda name: name.rpartition("}")[2]
    return {local(k): v for e in root.iter() if local(e.tag) == "Description" for k, v in e.attrib.items()}


def xmp_attributes(content: Column) -> Column:
    """The attributes of a column of files or packets as a map."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: attributes_of(None if x is None else bytes(x)))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "map<string,string>")(content.cast("binary"))
