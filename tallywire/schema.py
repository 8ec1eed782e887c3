"""Constants of the frame and record formats."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data format.
COMMA = 0xBC  # first byte of every frame
VERSION = 1
TICKS_PER_SAMPLE = 25  # of 20 ns
TICK_NS = 20
SAMPLES_PER_PACKET = 1024
CHANNELS = 128
FRAME_WORDS = 30
TRAILER_PATTERN = 0x708B309E
SYNC_PATTERN = 0x8B309E  # bits 40 to 63 of a transport header
LARGEST_MESSAGE = 265_000
MAX_EXCEPTIONS = 32
HISTOGRAM_BINS = 32
UNKNOWN_SOURCE = 0x7FF

# Bits of a frame's status word.
STATUS_BITS = {
    "bad_comma": 0, "bad_version": 1, "bad_id": 2, "bad_rsvd": 3, "bad_errors": 4, "bad_timestamp": 5,
    "cd0_stream_err1": 8, "cd0_stream_err2": 9, "cd0_rsvd0": 10, "cd0_checksum": 11, "cd0_convert": 12, "cd0_err_reg": 13, "cd0_rsvd1": 14, "cd0_hdrs": 15,
    "cd1_stream_err1": 16, "cd1_stream_err2": 17, "cd1_rsvd0": 18, "cd1_checksum": 19, "cd1_convert": 20, "cd1_err_reg": 21, "cd1_rsvd1": 22, "cd1_hdrs": 23,
    "run_disable": 24, "flush": 25, "sof_missing": 26, "sof_unexpected": 27, "eof_missing": 28, "eof_unexpected": 29, "eof_error": 30,
}
FRAMING_SHIFT = 26
#: What is kept of the first frame's status: as the format is used, and as its names say.
FIRST_FRAME_MASKS = {"as_written": 0x1F, "intended": 0x1F | 0x3F << 24 | 0x7 << 8 | 0x1 << 13 | 0x7 << 16 | 0x1 << 21}

# One test pulse of the emulator for each kind of channel, from the pedestal 0x800.
PULSE_MONO = [0x800, 0x900, 0xA00, 0xB00, 0xC00, 0xD00, 0xE00, 0xD00, 0xC00, 0xB00, 0xA00, 0x900, 0x800]
PULSE_BIPOLAR = [0x800, 0xB00, 0xD00, 0xE00, 0xD00, 0xB00, 0x800, 0x500, 0x300, 0x100, 0x300, 0x500, 0x800]
PEDESTAL = 0x800

COLD_DATA = T.StructType(
    [T.StructField(c, T.IntegerType()) for c in ("stream_err1", "stream_err2", "rsvd0")]
    + [T.StructField("checksums", T.LongType()), T.StructField("convert", T.IntegerType()), T.StructField("err_reg", T.IntegerType()), T.StructField("rsvd1", T.IntegerType())]
    + [T.StructField("hdrs", T.LongType()), T.StructField("adcs", T.ArrayType(T.IntegerType()))]
)
FRAME = T.StructType([T.StructField("words", T.ArrayType(T.LongType()))] + [T.StructField(c, T.BooleanType()) for c in ("sof", "run_enable", "eof_error", "flush")])
TRANSPORT_HEADER = T.StructType([T.StructField(c, T.LongType()) for c in ("frame_size", "tx_sequence", "rx_sequence", "type_id")])
