"""Reading catalog tables or files into the library's frames, and writing results."""

from promolens.sources.frames import Frames
from promolens.sources.readers import normalise, read_frame
from promolens.sources.sinks import publish_view, write_bucketed_mapping, write_pack_mapping

__all__ = ["Frames", "normalise", "publish_view", "read_frame", "write_bucketed_mapping",
           "write_pack_mapping"]
