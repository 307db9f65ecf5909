"""The core's queries; importing the package registers all of them."""

from postmill.plans import queries, streams  # noqa: F401
