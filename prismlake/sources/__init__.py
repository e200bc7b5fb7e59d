"""Images, synthetic images and the sparse coefficient file format."""
