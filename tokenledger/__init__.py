"""tokenledger: LLM API usage and cost analytics on Spark.

Recorded request/response exchanges go in (batch or stream); a typed,
priced request log comes out, plus the analytics, sketches and dimension
maintenance built on top of it. Everything is DataFrame / Spark SQL.
"""

from tokenledger.config import LedgerConfig

__all__ = ["LedgerConfig"]
