from airrline.streaming.ingest import stream_annotations, stream_counts

__all__ = ["stream_annotations", "stream_counts"]
