"""Structured Streaming: incremental, exactly-once landing of new monthly files."""

from tripmart.streaming.landing import clean_stream, land_trips, read_trip_stream

__all__ = ["clean_stream", "land_trips", "read_trip_stream"]
