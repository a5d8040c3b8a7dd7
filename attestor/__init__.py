"""Evidence-centred data integration as DataFrame operators: scan, extract, normalise, audit, export."""
