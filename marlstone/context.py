"""Who asks, and as of when: the scope every scan is bound to."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime


@dataclass(frozen=True)
class AccessContext:
    """Tenant, store and shares that a query may see; absent parts see nothing.

    as_of is always given: no query reads the clock.
    """

    as_of: datetime
    tenant_id: int | None = None
    store_id: int | None = None
    share_ids: tuple[int, ...] = ()
    user_id: int | None = None
    assigned_store_ids: tuple[int, ...] = ()
