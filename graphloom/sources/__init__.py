"""Readers and writers: source trees, diffs, traces, transcripts, snapshots, telemetry."""
