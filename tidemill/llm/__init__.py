"""Training-data operators: filters, language models, packing and mixing over a `documents` table."""
