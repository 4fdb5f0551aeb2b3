"""Query plans over the driver's tables; importing this registers them."""

from plumbline.plans import auditing, conceptual, deciding, joining, measuring, reporting, selecting  # noqa: F401
