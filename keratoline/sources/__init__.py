"""Readers: manifests, path lists, DICOM files, fixed-layout records, images and page items."""
