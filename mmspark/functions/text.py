"""Delimiter analysis and the signature analyzer (A1-A4)."""

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mmspark.functions.similarity import DEFAULT_K, MAX_K, minhash


@dataclass(frozen=True)
class AnalyzerConfig:
    num_hashes: int = DEFAULT_K
    type: str = "delimiter"
    delimiter: str = " "

    @classmethod
    def make(cls, text: str) -> "AnalyzerConfig | None":
        """The configuration of a JSON text; None if the number of hashes is out of range."""
        given = json.loads(text) if text.strip() else {}
        inner = given.get("analyzer", {})
        config = cls(given.get("numHashes", DEFAULT_K), inner.get("type", given.get("type", "delimiter")), inner.get("properties", inner).get("delimiter", given.get("delimiter", " ")))
        if not isinstance(config.num_hashes, int) or not 0 < config.num_hashes <= MAX_K:
            return None
        if config.type != "delimiter":
            raise ValueError(f"unsupported inner analyzer: {config.type}")
        return config

    def normalize(self) -> str:
        """The canonical text of the configuration."""
        return json.dumps({"numHashes": self.num_hashes, "analyzer": {"type": self.type, "properties": {"delimiter": self.delimiter}}}, separators=(",", ":"))


def normalize(text: str) -> str | None:
    """A configuration's text in its canonical form: the default one for none, a valid one as it is given, None for an invalid number of hashes."""
    config = AnalyzerConfig.make(text)
    if config is None:
        return None
    return text if text.strip() and json.loads(text) else config.normalize()


def tokenize(text: Column, delimiter: str = " ") -> Column:
    """Tokens between delimiters, empty ones dropped; a blank stands for any run of ASCII white space."""
    pattern = "[ \\t\\n\\x0B\\f\\r]+" if delimiter == " " else "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.filter(F.split(text, pattern), lambda t: t != "")


def minhash_tokens(df: DataFrame, text: str, config: AnalyzerConfig = AnalyzerConfig(), output: str = "tokens") -> DataFrame:
    """The `slot:value` tokens of a text's signature; a text without tokens still has one a slot."""
    signed = minhash(df.withColumn("__t", tokenize(F.col(text), config.delimiter)), "__t", config.num_hashes, "__s")
    value = lambda v: F.when(v == -1, F.lit(str(2**64 - 1))).otherwise(v.cast("string"))
    return signed.withColumn(output, F.transform("__s", lambda v, i: F.concat(i.cast("string"), F.lit(":"), value(v)))).drop("__t", "__s")
