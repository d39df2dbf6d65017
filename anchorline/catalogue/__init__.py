"""Every operator mapped onto the driver's tables, with equivalent SQL."""

from anchorline.catalogue import cohorts, events, survival, tables  # noqa: F401
from anchorline.catalogue.registry import ORACLES, QUERIES  # noqa: F401
