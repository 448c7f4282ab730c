"""Settings of the service, from the session's configuration."""

from __future__ import annotations

from decimal import Decimal

from pydantic import BaseModel, ConfigDict, Field
from pyspark.sql import SparkSession

PREFIX = "spark.proofmark."


class Settings(BaseModel):
    """Each field is the setting ``spark.proofmark.<field>``; unset ones have these values, others of no use are an error."""

    model_config = ConfigDict(extra="forbid", frozen=True)
    daily_limit: Decimal = Field(Decimal("5.00"), ge=0, description="dollars a day for the reader")
    reader_name: str = Field("", description="which reader fills the extractions; empty: none is reachable")
    rotations: bool = Field(True, description="whether batches read sideways labels again")
    workers: int = Field(6, ge=1, description="tasks of a batch of up to 1,000 labels at a time")

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        given = {k: spark.conf.get(PREFIX + k, None) for k in cls.model_fields}
        return cls(**{k: v for k, v in given.items() if v is not None})
