"""Engine settings. Prefixes are parameters with neutral defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LedgerConfig:
    # Gateway header prefix (lower case, no trailing dash): headers named
    # ``<prefix>...`` are kept, ``<prefix>-`` is stripped for metadata.
    header_prefix: str = "x-gw"
    api_key_prefix: str = "gwsk_"
    proxy_key_prefix: str = "gwpk_"
    # Bytes of an error body kept in error_message.
    error_message_bytes: int = 500
    # Bodies stored in the log table are cut to this many bytes.
    max_body_bytes: int = 65_536
    # Where bodies go: "object" (body_s3_key set, bodies not in the table),
    # "table" (bodies truncated into request_body/response_body) or "none".
    body_mode: str = "object"
    store_request_body: bool = True
    store_response_body: bool = True
    # Dimensions at most this large (optimizer estimate) are broadcast.
    dim_broadcast_bytes: int = 64 * 1024 * 1024

    @property
    def key_header(self) -> str:
        return f"{self.header_prefix}-key"

    @property
    def provider_header(self) -> str:
        return f"{self.header_prefix}-provider"

    @property
    def alias_header(self) -> str:
        return f"{self.header_prefix}-provider-alias"


DEFAULT = LedgerConfig()
