from tickweave.sources.feed import DueSlots, feed
from tickweave.sources.files import (
    read_profiles, read_readings, read_resources, stream_readings, write_events,
    write_events_stream, write_profiles, write_report, write_resource_documents, write_resources,
)
from tickweave.sources.synthetic import stream_synthetic
from tickweave.sources.tables import events_as_readings

__all__ = [
    "DueSlots", "events_as_readings", "feed", "read_profiles", "read_readings", "read_resources", "stream_readings",
    "stream_synthetic", "write_events", "write_events_stream", "write_profiles", "write_report",
    "write_resource_documents", "write_resources",
]
