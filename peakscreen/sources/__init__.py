"""Sources and sinks: instrument exports, report tables, feature tables, models."""

from peakscreen.sources.instrument import (  # noqa: F401
    ParsedFiles, read_text_files, header_index, header_line_number, parse_files,
    read_instrument_dir, read_upload, union_batches, with_row_id)
from peakscreen.sources.tables import (  # noqa: F401
    read_reports, write_table, read_table, save_model, load_model)
